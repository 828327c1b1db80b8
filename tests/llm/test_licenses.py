import math
import random
import re

from fixtures_llm import SF, documents, odd_texts, prose

from geoloom.llm import licenses
from geoloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    """The base columns, and the labels of every window of each template's block size."""
    w, base = words(text), []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        base += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    labels, best = {label for _, label in base}, 1.0 if base else 0.0
    for label, template in licenses.TEMPLATES:
        own = set(words(template))
        need = math.ceil(0.8 * len(own) - 1e-9)
        span = len(template.split()) + sum(template.count(c) for c in "-./")
        size = 1 << math.ceil(math.log2(2 * span))
        for a in range(0, max(1, len(w)), size // 2):
            found = len(own & set(w[a : a + size]))
            if found >= need and (a == 0 or a + size // 2 < len(w)):
                labels.add(label)
                best = max(best, found / len(own))
    at = [i for i, _ in base]
    return len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), round(best, 9)


def rows_of(df):
    return [repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9))) for r in df.collect()]


def test_rows_as_brute_force(spark):
    filler = " ".join(["word"] * 37)
    rows = odd_texts() + [(300 + i, f"{filler} {t} {filler}" * 2) for i, (_, t) in enumerate(licenses.TEMPLATES)]
    rows += [(400, "Licensed under Apache Version 2.0, the"), (401, "the of and is in license"), (402, "mit\nlicense MIT licenses x mit-license")]
    assert sorted(rows_of(licenses.scan(documents(spark, rows)))) == sorted(repr((k, *brute(t))) for k, t in rows)
    assert licenses.scan(documents(spark, [])).count() == 0


def test_a_thousand_templates(spark):
    r = random.Random(8)
    made = ["".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(4000)]
    templates = [(f"t{i}", " ".join(r.sample(made, 12))) for i in range(1000)]
    held = {i: r.sample(range(1000), 3) for i in range(40)}
    rows = [(i, " ".join(f"{prose(i * 7 + k, 30)} {templates[t][1]}" for k, t in enumerate(own))) for i, own in held.items()]
    for row in licenses.scan(documents(spark, rows), templates=templates).collect():
        assert {f"t{t}" for t in held[row.doc_id]} <= set(row.labels.split(","))
        w = words(rows[row.doc_id][1])
        for m in row.matches:
            own = set(words(templates[m.template][1]))
            assert len(own & set(w[m.start_word : m.end_word])) >= 0.8 * len(own) - 1e-9


def test_query_over_the_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(rows_of(QUERIES["op4_license_scan"](spark, SF))) == sorted(repr((k, *brute(t))) for k, t in docs)
