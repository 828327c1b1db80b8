"""The registered queries of this subpackage and the SQL that states their rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import chunks, dialogue, licenses, linedup, merkle, neardup, packing, pages, quality, tokens, topk, vectors, warc

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with chunk reuse and decoded again, as digests."""
    ids = chunks.encode(read(spark, sf_dir, "documents"))
    back = chunks.decode(ids)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it exceeds 512 tokens."""
    return tokens.token_counts(read(spark, sf_dir, "documents"), limit=512)


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"), 2048)


@query
def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of the line-first quality rules for every document."""
    return quality.quality(read(spark, sf_dir, "documents"), with_text=False)


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives, normalised to members, and read back by offset."""
    back = warc.archive(read(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op7_warc"] = """
with p as (select page_id, coalesce(html, '') h from pages),
d as (select page_id, strlen(h)::bigint payload_bytes, sha256(h) payload_digest from p),
f as (select payload_digest, min(page_id) first_id from d where payload_bytes >= 100 group by 1)
select d.page_id, d.payload_bytes, d.payload_digest,
  case when first_id < d.page_id then 'revisit' else 'response' end record_type,
  case when first_id < d.page_id then first_id end refers_to
from d left join f using (payload_digest)
"""


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and the blocks that meet a license template, for every document."""
    return licenses.scan(read(spark, sf_dir, "documents"))


@query
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return pages.extract(read(spark, sf_dir, "pages"))


@query
def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors of greatest inner product for every fiftieth vector."""
    return topk.top_k(read(spark, sf_dir, "embeddings"), 5, "vec_id % 50 = 0")


ORACLES["op3_exact_topk"] = """
with v as (select vec_id, [floor(256 * x::double)::bigint for x in embedding] v from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
p as (select q.vec_id query_id, c.vec_id, list_sum([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)])::bigint score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, rank::int rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) rank from p) where rank <= 5
"""


@query
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later copies of repeated line runs, as spans and a digest of what stays."""
    out = linedup.dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_deleted_lines", "n_deleted_words", "spans", F.sha2("clean_text", 256).alias("clean_sha256"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proof of every document, folded again after some documents have been tampered with."""
    docs = read(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    return merkle.audit(merkle.manifest(docs, now={"text": tampered}))


#: The bits of CRC-32 over the decimal digits of an id, and the tree level by level, up to the root.
_CRC = """list_reduce(list_prepend(4294967295::bigint, [ascii(c)::bigint for c in string_split(doc_id::varchar, '')]), lambda a, b:
  list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))"""


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"


def _fields(text: str) -> str:
    return " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text))


_STEP = """
  select w.k, w.g, w.lev + 1 lev, w.i // 8 i, w.s || coalesce(string_agg(t.h, '' order by t.i) filter (t.i <> w.i), '') s,
    sha256(coalesce(string_agg(t.h, '' order by t.i) filter (t.i < w.i), '') || w.f || coalesce(string_agg(t.h, '' order by t.i) filter (t.i > w.i), '')) f
  from {walk} w join {tree} t on t.g = w.g and t.lev = w.lev and t.i // 8 = w.i // 8 and t.n > 1
  group by w.k, w.g, w.lev, w.i, w.s, w.f
"""
ORACLES["op11_merkle_manifest"] = f"""
with recursive d as (select *, 4294967295 - {_CRC} crc, row_number() over () k from documents),
leaf as (select k, doc_id, coalesce('v' || lang, '') g, sha256({_fields("text")}) h,
  sha256({_fields("(case when crc % 3 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end)")}) f from d),
low as (select *, row_number() over (partition by g order by doc_id nulls first, h) - 1 i, count(*) over (partition by g) n from leaf),
tree as (select g, 0 lev, i, h, n from low union all
  select g, lev + 1, i // 8, sha256(string_agg(h, '' order by i)), (n + 7) // 8 from tree where n > 1 group by g, lev, i // 8, n),
subroot as (select g, h, row_number() over (order by g) - 1 i, count(*) over () n from tree where n = 1),
top as (select 0 g, 0 lev, i, h, n from subroot union all
  select g, lev + 1, i // 8, sha256(string_agg(h, '' order by i)), (n + 7) // 8 from top where n > 1 group by g, lev, i // 8, n),
walk as (select k, g, 0 lev, i, '' s, f from low union all {_STEP.format(walk="walk", tree="tree")}),
done as (select k, arg_max(s, lev) s, arg_max(f, lev) f from walk group by k),
climb as (select done.k, 0 g, 0 lev, subroot.i, s, done.f from done join low using (k) join subroot using (g) union all {_STEP.format(walk="climb", tree="top")}),
ended as (select k, arg_max(s, lev) s, arg_max(f, lev) f from climb group by k),
root as (select h root from top where n = 1)
select doc_id, leaf.h leaf, subroot.h subroot, root, sha256(s) proof_sha256, ended.f folded_root, ended.f = root verified
from leaf join subroot using (g) join ended using (k), root
"""


@query
def op12_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, their faults, and the cheapest repair of each."""
    every = read(spark, sf_dir, "conversations")
    rows = dialogue.damaged(every)
    found = cut_lineage(dialogue.repair(rows))
    found = found.join(dialogue.repaired_digests(rows, found).withColumnRenamed("conv_id", "conv"), F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv").withColumnRenamed("conv_id", "conv")
    out = every.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@query
def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector, by cosine within its label."""
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


ORACLES["op13_near_vectors"] = """
with recursive v as (select vec_id, label, embedding::double[] e from embeddings),
good as (select vec_id, label, [x / sqrt(list_sum([y * y for y in e])) for x in e] u from v
  where label is not null and e is not null and len([x for x in e if x is null or not isfinite(x)]) = 0 and len([x for x in e if x <> 0]) > 0),
link as (select a.vec_id a, b.vec_id b from good a join good b on a.label = b.label and a.vec_id <> b.vec_id and list_dot_product(a.u, b.u) >= 0.93),
reach as (select vec_id, vec_id other from v union select reach.vec_id, link.b from reach join link on link.a = reach.other),
least as (select vec_id, min(other) component_id from reach group by 1)
select vec_id, (select count(*) from link where a = vec_id)::bigint n_links, component_id, vec_id = component_id kept from least
"""
