import re
from collections import Counter

from fixtures_llm import SF, documents, odd_texts

from geoloom.llm import quality
from geoloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many, cover, seen, dup = Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if many[g] > 1:
            cover |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), len(words) < 50 or 100 * len(cover) > 50 * len(words)


def fails(line):
    words = WORD.findall(line)
    if not words:
        return False
    close = re.compile(r"[.!?:;\"')\]。！？…”’»」』।؟۔：；）]$")
    bad = not close.search(words[-1]) and sum(bool(re.search(r"[.!?:;\"')\]]$", w)) for w in words) < 2
    bars = sum(w in set("|>/-*~»›•·→") for w in words)
    symbols = len(re.findall(r"[#*$%&|<>]", line))
    low = re.sub("[A-Z]", lambda m: m[0].lower(), line)
    return bad or (bars > 0 and 10 * bars >= len(words)) or (symbols > 0 and 4 * symbols >= len(words)) or any(p in low for p in quality.BOILERPLATE)


def verdict(text):
    n, *_, failed = base(text)
    kept = [line for line in (text or "").split("\n") if not fails(line)]
    words = sum(len(WORD.findall(x)) for x in kept)
    return not failed and words >= 0.5 * n, "\n".join(kept)


def test_rows_as_brute_force(spark):
    rows = odd_texts() + [(200, "All Rights Reserved here.\nA fine line ends.\nhome | news | sport"), (201, "\n".join(["Plain words stand here and there and close."] * 3 + ["no end"] * 20))]
    got = quality.quality(documents(spark, rows))
    want = [(k, *base(t), *verdict(t)) for k, t in rows]
    mine = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.clean_text) for r in got.collect()]
    assert sorted(map(repr, mine)) == sorted(map(repr, want))
    assert quality.quality(documents(spark, [])).count() == 0


def test_query_over_the_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op9_line_quality"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = base(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert r.kept == verdict(docs[r.doc_id])[0]


def test_clean_documents_stay(spark):
    rows = QUERIES["op9_line_quality"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("quality = 1 and not base_failed").collect()
    assert rows and all(r.kept for r in rows)


def test_keep_good_keeps_columns(spark):
    docs = documents(spark)
    out = quality.keep_good(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert sorted(repr(r.doc_id) for r in out.collect()) == sorted(repr(k) for k, t in odd_texts() if verdict(t)[0])
