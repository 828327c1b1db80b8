"""Run-history operators: indexed units, text blocks, search, usage."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geom import bound, let
from ..session import cut_lineage
from .catalog import collapse_space

# Search constants of the history index.
BM25_K1 = 1.2
BM25_B = 0.75
BM25_LEAST_IDF = 1e-6

WORD = r"[\p{L}\p{N}]+"
#: Steps per bucket of a cell; keeps every ordered window bounded.
BUCKET = 4096


def clip(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.substring(text, 1, chars)


def step_units(steps: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Tool calls and non-empty tool results as units; ``args`` is JSON text, keys come out sorted."""
    name = F.coalesce(F.when(F.col("name") != "", F.col("name")), F.lit("tool"))
    args = F.coalesce(F.to_json(F.try_parse_json("args")), F.when(F.col("args").isNull(), "null").otherwise(F.col("args")))
    text = F.when(F.col("type") == "tool_call", F.concat(name, F.lit(" called with "), args)).when(
        (F.col("type") == "tool_result") & (F.col("content") != ""), F.concat(name, F.lit(" result: "), F.col("content"))
    )
    return steps.select(
        "cell_id", F.col("type").alias("kind"), "step_index", F.col("tool_call_id").alias("step_id"),
        F.col("name").alias("tool_name"), clip(text, max_chars).alias("text"),
    ).where("text is not null and text <> ''")


def running_total(df: DataFrame, keys: list[str], order: str, value: Column, out: str, bucket: int = BUCKET) -> DataFrame:
    """A running sum per key in two levels, so that one long key is split over tasks.

    ``order`` is a non-negative integer.  Buckets of it are summed first, their own
    running sums are joined back, and the row-level window stays inside one bucket.
    """
    staged = df.withColumn("_b", F.floor(F.col(order) / bucket)).withColumn("_v", value.cast("long"))
    sums = staged.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_b")
    sums = sums.select(*keys, "_b", (F.sum("_s").over(before) - F.col("_s")).alias("_base"))
    inside = Window.partitionBy(*keys, "_b").orderBy(order)
    local = staged.withColumn("_local", F.sum("_v").over(inside))
    return local.join(sums, [*keys, "_b"]).withColumn(out, F.col("_base") + F.col("_local")).drop("_b", "_v", "_local", "_base")


def fold_text(steps: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Text deltas folded into blocks, one row per visible block.

    A ``text`` step starts a block, ``text_delta`` extends it, any other step and any
    reasoning closes it; reasoning itself is not kept.
    """
    is_text = F.col("type").isin("text", "text_delta")
    reasoning = F.coalesce("reasoning", F.lit(False))
    shown = is_text & ~reasoning
    useful = steps.where(~shown | (F.col("content") != ""))
    opens = ~shown | (F.col("type") == "text")
    slim = useful.select("cell_id", "step_index", "type", "content", opens.cast("int").alias("opens"), shown.alias("shown"))
    marked = running_total(slim, ["cell_id"], "step_index", F.col("opens"), "block").where("shown")
    blocks = marked.groupBy("cell_id", "block").agg(
        F.min("step_index").alias("step_index"), F.array_sort(F.collect_list(F.struct("step_index", "content"))).alias("parts")
    )
    text = clip(collapse_space(F.array_join(F.transform("parts", lambda p: p["content"]), "")), max_chars)
    return blocks.select("cell_id", "step_index", F.lit("assistant").alias("kind"), text.alias("text")).where("text <> ''")


def final_answers(results: DataFrame, max_chars: int | None = None) -> DataFrame:
    """The answer of each finished run, or its error; empty ones are left out."""
    done = F.col("status") == "done"
    text = F.when(done, F.col("output")).otherwise(F.coalesce(F.when(F.col("error") != "", F.col("error")), F.col("output")))
    return results.select(
        "cell_id", F.when(done, "response").otherwise("error").alias("kind"), clip(collapse_space(text), max_chars).alias("text")
    ).where(text.isNotNull() & (text != ""))


def drop_repeated_answers(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Remove the trailing assistant blocks of a cell that only repeat its final answer."""
    done = answers.where("kind = 'response'").select("cell_id", F.col("text").alias("_answer"))
    both = blocks.join(done, "cell_id", "left")
    other = both.where("_answer is not null and text <> _answer").groupBy("cell_id").agg(F.max("step_index").alias("_last"))
    kept = both.join(other, "cell_id", "left").where(
        F.col("_answer").isNull() | (F.col("step_index") <= F.coalesce("_last", F.lit(-1)))
    )
    return kept.drop("_answer", "_last")


def latest_run(units: DataFrame, run: str = "run_seq") -> DataFrame:
    """Only the rows of each cell's latest run."""
    newest = units.groupBy("cell_id").agg(F.max(run).alias("_newest"))
    return units.join(newest, "cell_id").where(F.col(run) == F.col("_newest")).drop("_newest")


def forget_cells(units: DataFrame, cells: DataFrame) -> DataFrame:
    return units.join(cells.select("cell_id").distinct(), "cell_id", "left_anti")


def unit_counts(units: DataFrame) -> DataFrame:
    return units.groupBy("cell_id").agg(F.count(F.lit(1)).alias("units"))


# -- search ---------------------------------------------------------------


def query_terms(query: Column, limit: int | None = None) -> Column:
    """The words of a query that differ when case and accents are ignored, in order; with ``limit``, the first ones."""
    # a text has far fewer spellings than words; only these are folded
    words = F.array_distinct(F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(WORD), F.lit(0)))
    # sorted by folded word and place, the first of equal neighbours is the first spelling
    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(fold(w).alias("low"), i.alias("at"), w.alias("own"))))

    def first_spellings(p: Column) -> Column:
        first = F.filter(p, lambda v, i: (i == 0) | (F.get(p, i - 1)["low"] != v["low"]))
        fresh = F.sort_array(F.transform(first, lambda v: F.struct(v["at"].alias("at"), v["own"].alias("own"))))
        return F.transform(fresh if limit is None else F.slice(fresh, 1, limit), lambda v: v["own"])

    return let(placed, first_spellings)


def term_list(query: str, limit: int | None = None) -> list[str]:
    """The same for a query given as text, folded like the indexed tokens."""
    return list(dict.fromkeys(fold_text_value(w) for w in re.findall(r"[^\W_]+", query or "")))[:limit]


def fold_text_value(text: str) -> str:
    plain = unicodedata.normalize("NFD", text.lower())
    return "".join(c for c in plain if not unicodedata.combining(c))


def _accents() -> tuple[str, str]:
    """Letters with marks and their base letters, from the Unicode decomposition."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        low = chr(code).lower()
        base = unicodedata.normalize("NFD", low)[0]
        if len(low) == 1 and base != low:
            pairs.append((low, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    src, dst = _accents()
    return F.regexp_replace(F.translate(F.lower(text), src, dst), r"\p{M}+", "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(0))


def _bm25(tf: Column, dl: Column, docs: Column, avg: Column, df: Column) -> Column:
    idf = F.log((docs - df + 0.5) / (df + 0.5))
    idf = F.when(idf <= 0, F.lit(BM25_LEAST_IDF)).otherwise(idf)
    return idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * dl / avg))


def _occurrences(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda t: t == term))


def score_units(units: DataFrame, query: str) -> DataFrame:
    """Every matching unit with its BM25 ``score`` (lower is better).

    Term counts are row-local, so a query costs one small aggregate and one pass; no
    inverted table is shuffled.  ``search_index`` serves repeated queries.
    """
    terms = term_list(query)
    if not terms:
        return units.withColumn("score", F.lit(0.0)).where(F.lit(False))
    toks = units.withColumn("_t", tokens(F.col("text")))
    counted = toks.withColumns(
        {
            "_dl": F.size("_t"),
            "_tf": F.array(*[_occurrences("_t", w) for w in terms]),
        }
    ).drop("_t")
    stats = counted.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"), F.avg("_dl").alias("avg"),
            F.array(*[F.count_if(F.col("_tf")[i] > 0) for i in range(len(terms))]).alias("df"),
        )
    )
    hit = counted.where(F.exists("_tf", lambda v: v > 0)).withColumn("_st", stats.scalar())
    parts = [_bm25(F.col("_tf")[i], F.col("_dl"), F.col("_st.n"), F.col("_st.avg"), F.col("_st.df")[i]) for i in range(len(terms))]
    score = parts[0]
    for p in parts[1:]:
        score = score + p
    return hit.withColumn("score", -score).drop("_st", "_tf", "_dl")


def search(units: DataFrame, query: str, limit: int = 6, hint_words: int | None = None, preview_chars: int | None = None) -> DataFrame:
    """The best units with a hint and the cell's latest prompt and answer, blanks collapsed.

    The hint is the unit's text from the first match on, led by half of ``hint_words`` where that is given
    and cut to that many words; previews are cut to ``preview_chars`` where given.
    """
    # at most ``limit`` rows, read three times below
    best = cut_lineage(score_units(units, query).orderBy("score", "id").limit(max(1, int(limit))))
    terms = F.array(*[F.lit(t) for t in term_list(query)])
    words = F.split(collapse_space(F.col("text")), " ")
    at = F.coalesce(
        F.array_position(F.transform(words, lambda w: F.arrays_overlap(tokens(w), terms)), True), F.lit(1)
    ).cast("int")
    size = F.size(words) if hint_words is None else F.lit(hint_words)
    start = F.greatest(at - F.lit((hint_words or 0) // 2), F.lit(1))
    cut = F.array_join(F.slice(words, start, size), " ")
    hint = F.concat(F.when(start > 1, F.lit("…")).otherwise(""), cut, F.when(F.size(words) >= start + size, F.lit("…")).otherwise(""))
    best = best.withColumn("hint", hint)
    cells = units.join(best.select("cell_id").distinct(), "cell_id", "left_semi")

    def preview(kinds: list[str], name: str) -> DataFrame:
        rows = cells.where(F.col("kind").isin(*kinds))
        return rows.groupBy("cell_id").agg(collapse_space(clip(F.max_by("text", "id"), preview_chars)).alias(name))

    out = best.join(preview(["prompt"], "prompt"), "cell_id", "left").join(preview(["response", "error"], "answer"), "cell_id", "left")
    step = F.when(F.col("step_index").isNotNull(), F.concat(F.lit(" · step "), F.col("step_index"))).otherwise("")
    tool = F.when(F.col("tool_name") != "", F.concat(F.lit(" · "), F.col("tool_name"))).otherwise("") if "tool_name" in out.columns else F.lit("")
    return out.withColumn("reference", F.concat(F.lit("prompt cell "), F.col("cell_id"), F.lit(" · "), F.col("kind"), tool, step))


def token_index(units: DataFrame) -> DataFrame:
    """The inverted table ``term, id, tf, dl`` for repeated queries; write it partitioned by ``shard``."""
    rows = units.select("id", tokens(F.col("text")).alias("_t")).withColumn("dl", F.size("_t"))
    rows = rows.select("id", "dl", F.explode("_t").alias("term"))
    return rows.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl")).withColumn(
        "shard", F.pmod(F.hash("term"), F.lit(256))
    )


def search_index(index: DataFrame, sizes: DataFrame, query: str, limit: int = 6) -> DataFrame:
    """Ranked unit ids from a stored index; ``sizes`` is one row ``n, avg``.

    The query's terms become literals on ``shard`` and ``term``, so only their shards are read.
    """
    terms = term_list(query)
    shard = F.pmod(F.hash("term"), F.lit(256))
    wanted = index.sparkSession.createDataFrame([(t,) for t in terms], "term string").select("term", shard.alias("shard"))
    shards = [r[0] for r in wanted.select("shard").distinct().collect()] if terms else []
    rows = index.where(F.col("shard").isin(*shards) & F.col("term").isin(*terms)) if terms else index.where(F.lit(False))
    freq = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = rows.join(freq, "term").withColumn("_s", sizes.select(F.struct("n", "avg")).scalar())
    return scored.groupBy("id").agg(
        (-F.sum(_bm25(F.col("tf"), F.col("dl"), F.col("_s.n"), F.col("_s.avg"), F.col("df")))).alias("score")
    ).orderBy("score", "id").limit(max(1, int(limit)))


# -- runs and usage -------------------------------------------------------


def trace_runs(records: DataFrame) -> DataFrame:
    """One row per trace: the last run and result records win, steps are counted.

    ``records`` has ``cell_id, seq, type`` and the run/result fields; the ordered steps
    themselves stay in the step table.
    """

    def last(field: str, kind: str) -> Column:
        return F.max_by(field, F.when(F.col("type") == kind, F.col("seq"))).alias(field)

    return records.groupBy("cell_id").agg(
        *[last(f, "run") for f in ("run_id", "model", "prompt")],
        *[last(f, "result") for f in ("status", "output", "error")],
        F.count_if(F.col("type") == "step").alias("steps"),
    )


def flatten_usage(df: DataFrame, usage: str = "usage") -> DataFrame:
    """Token counters of a usage JSON text; zero cache counters fall back to provider details."""
    u = F.from_json(
        F.col(usage),
        "requests long, input_tokens long, output_tokens long, total_tokens long, tool_calls long, "
        "cache_read_tokens long, cache_write_tokens long, cost double, details map<string,long>",
    )
    staged = df.withColumn("_u", u)

    def counter(name: str) -> Column:
        return F.coalesce(F.col(f"_u.{name}"), F.lit(0))

    def cache(name: str, detail: str) -> Column:
        own = counter(name)
        return F.when(own != 0, own).otherwise(F.coalesce(F.col("_u.details")[detail], F.lit(0)))

    return staged.withColumns(
        {
            **{n: counter(n) for n in ("requests", "input_tokens", "output_tokens", "total_tokens", "tool_calls")},
            "cache_read_tokens": cache("cache_read_tokens", "prompt_cache_hit_tokens"),
            "cache_write_tokens": cache("cache_write_tokens", "prompt_cache_miss_tokens"),
            "cost": F.col("_u.cost"),
        }
    ).drop("_u")


def usage_rows(runs: DataFrame, messages: str = "messages") -> DataFrame:
    """One row per model response in a run's messages, with the tools it called."""
    kind = "array<struct<kind:string,model_name:string,timestamp:string,usage:string,parts:array<struct<tool_name:string>>>>"
    rows = runs.withColumn("_m", F.explode(F.from_json(messages, kind))).where(F.col("_m.kind") == "response")
    tools = F.filter(F.transform("_m.parts", lambda p: p["tool_name"]), lambda t: t.isNotNull())
    rest = [c for c in runs.columns if c != messages]
    return flatten_usage(
        rows.select(*rest, F.col("_m.model_name").alias("model"), F.col("_m.timestamp").alias("timestamp"),
                    F.coalesce(tools, F.array().cast("array<string>")).alias("tools"), F.col("_m.usage").alias("usage"))
    )


def usage_by_model(rows: DataFrame) -> DataFrame:
    return rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("responses"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("cache_read_tokens").alias("cache_read_tokens"), F.sum(F.size("tools")).alias("tool_parts"),
    )


# -- tool results ---------------------------------------------------------


_STEP = re.compile(r"\[\s*(?:(?P<from>-?\d+)?\s*(?P<span>:)\s*(?P<to>-?\d+)?|(?P<item>-?\d+))\s*\]|(?P<name>[^.\[\]]+)")


class _Value:
    """A JSON value in a column, seen as each of the kinds that a step may ask for; NULL where it is another kind."""

    def __init__(self, value: Column):
        kind = F.schema_of_variant(value)
        self.value = value
        self.members = F.when(kind.startswith("OBJECT"), F.json_object_keys(F.to_json(value)))
        self.items = F.when(kind.startswith("ARRAY"), value.try_cast("array<variant>"))
        self.text = F.when(kind == "STRING", value.try_cast("string"))
        self.size = F.coalesce(F.size(self.items), F.length(self.text))

    def keys(self) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(self.items)), lambda i: i < F.size(self.items))
        return F.coalesce(F.to_variant_object(self.members), F.to_variant_object(places))

    def length(self) -> Column:
        return F.coalesce(F.size(self.members), self.size).cast("variant")

    def member(self, name: str) -> Column:
        return F.when(self.members.isNotNull(), F.try_variant_get(self.value, f"$.{name}", "variant"))

    def item(self, at: int) -> Column:
        place = self._from_end(at)
        letter = F.when(place.between(0, F.length(self.text) - 1), F.substring(self.text, place + 1, F.lit(1)))
        return F.coalesce(F.get(self.items, place), letter.cast("variant"))

    def span(self, start: int, stop: int | None) -> Column:
        first = F.greatest(self._from_end(start), F.lit(0))
        last = self.size if stop is None else F.least(self._from_end(stop), self.size)
        many = F.greatest(last - first, F.lit(0))
        return F.coalesce(F.to_variant_object(F.slice(self.items, first + 1, many)), F.substring(self.text, first + 1, many).cast("variant"))

    def _from_end(self, at: int) -> Column:
        return F.lit(at) if at >= 0 else self.size + F.lit(at)


def _steps(path: str) -> list[tuple]:
    """The steps of a path, each as the name of what it does and its arguments."""
    out: list[tuple] = []
    for m in _STEP.finditer(path):
        if m["span"]:
            out.append(("span", int(m["from"] or 0), int(m["to"]) if m["to"] else None))
        elif m["item"]:
            out.append(("item", int(m["item"])))
        else:
            out.append((m["name"],) if m["name"] in ("keys", "length") else ("member", m["name"]))
    return out


def json_path(df: DataFrame, column: str, path: str, out: str = "value") -> DataFrame:
    """A jq-like path over JSON text: keys, ``[i]``, ``[a:b]``, ``keys``, ``length``; NULL where it fails."""
    # each step reads the value before it several times
    found = bound(df, {"_found": F.try_parse_json(F.col(column))})
    for what, *arguments in _steps(path):
        found = bound(found, {"_found": getattr(_Value(F.col("_found")), what)(*arguments)})
    return found.withColumn(out, F.to_json("_found")).drop("_found")


def page_links(pages: DataFrame, html: str = "html", link_class: str = "result__a", snippet_class: str = "result__snippet", redirect_host: str = "duckduckgo.com") -> DataFrame:
    """Search results in HTML pages: title, address (redirects unwrapped) and snippet, in page order.

    Anchors of ``snippet_class`` describe the nearest result link before them.
    """
    anchor = r"(?is)<a\b[^>]*>.*?</a\s*>"
    rest = [c for c in pages.columns if c != html]

    def attribute(head: Column, name: str) -> Column:
        found = F.regexp_extract(head, rf"(?is)(?:^|\s){name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
        return F.regexp_replace(found, "^[\"']|[\"']$", "")

    def parsed(a: Column, pos: Column) -> Column:
        """Each part is bound once: the head, its classes, the address of a link."""

        def by_class(head: Column, classes: Column) -> Column:
            named = F.array_contains(classes, link_class) if link_class else F.lit(True)
            return let(F.when(named, html_text(attribute(head, "href"))), lambda href: described(classes, href))

        def described(classes: Column, href: Column) -> Column:
            link, snippet = F.coalesce(href != "", F.lit(False)), F.array_contains(classes, snippet_class)
            body = F.regexp_replace(F.regexp_extract(a, r"(?is)^<a\b[^>]*>(.*?)</a\s*>$", 1), r"(?s)<!--.*?-->|<[^>]*>", "")
            # only anchors that count have their text resolved
            text = F.when(link | snippet, collapse_space(html_text(body)))
            return F.struct(pos.alias("pos"), link.alias("link"), (snippet & ~link).alias("snippet"), href.alias("href"), text.alias("text"))

        return let(F.regexp_extract(a, r"(?is)^<a\b([^>]*)>", 1), lambda head: let(F.split(attribute(head, "class"), r"\s+"), lambda classes: by_class(head, classes)))

    anchors = F.regexp_extract_all(F.col(html), F.lit(anchor), F.lit(0))
    if link_class:
        # a class that an anchor does not contain anywhere it does not have
        anchors = F.filter(anchors, lambda a: F.contains(a, F.lit(link_class)) | F.contains(a, F.lit(snippet_class)))
    # a page is one row: its anchors are paired inside the row, without a shuffle
    found = pages.select(*rest, F.transform(anchors, parsed).alias("_a"))
    found = found.select(
        *rest, F.filter("_a", lambda a: a["link"]).alias("_links"), F.filter("_a", lambda a: a["snippet"] & (a["text"] != "")).alias("_notes")
    )
    rows = found.select(*rest, "_notes", F.col("_links.pos").alias("_at"), F.posexplode("_links").alias("_i", "_l"))
    after = F.coalesce(F.get("_at", F.col("_i") + 1), F.lit(2**31 - 1))
    own = F.filter("_notes", lambda s: (s["pos"] > F.col("_l.pos")) & (s["pos"] < after))
    note = F.get(own, F.size(own) - 1)["text"]
    return rows.select(
        *rest, (F.col("_i") + 1).cast("long").alias("rank"), F.col("_l.text").alias("title"),
        destination(F.col("_l.href"), redirect_host).alias("url"), F.coalesce(note, F.lit("")).alias("snippet"),
    )


def html_text(text: Column) -> Column:
    """The common character references resolved; ``&amp;`` last so that nothing is resolved twice."""
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def destination(href: Column, redirect_host: str) -> Column:
    """The real address behind a result link that goes through a redirect."""
    full = F.when(F.startswith(href, F.lit("//")), F.concat(F.lit("https:"), href)).otherwise(href)
    host = F.regexp_extract(full, r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)
    target = F.regexp_extract(full, r"[?&]uddg=([^&#]+)", 1)
    return F.when(F.endswith(host, F.lit(redirect_host)) & (target != ""), F.try_url_decode(target)).otherwise(full)


def unique_names(df: DataFrame, name: str = "filename", order: str = "ordinal", out: str = "name") -> DataFrame:
    """The nth repeat of a name gets ``_n`` before its suffix, in input order.

    Repeats are numbered with a two-level running count, so one very common name is
    not one task's work.
    """
    base = F.regexp_extract(F.col(name), r"([^/]*)$", 1)
    counted = running_total(df.withColumn("_plain", base), ["_plain"], order, F.lit(1), "_nth")
    stem, suffix = (F.regexp_extract("_plain", r"^(.+?)(\.[^.]+)?$", i) for i in (1, 2))
    nth = F.col("_nth") - 1
    return counted.withColumn(
        out, F.when(nth > 0, F.concat(stem, F.lit("_"), nth.cast("string"), suffix)).otherwise(F.col("_plain"))
    ).drop("_plain", "_nth")
