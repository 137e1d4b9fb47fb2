"""One registered query per operator, over whole tables, and SQL twins where SQL can state the answer."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from canopyframe.llm import attention_lm, decontaminate, jaccard, licenses, merkle, mixing, ogg, quality, secret_scan, template, toxicity, url_filter, whitening
from canopyframe.llm.common import crc_rest, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


# Fixed values of the contract: host, path, verdict.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: hosts listed whole; they decide where no rule fits
LISTED_HOSTS = ["spam-farm.example.org", "cheap-pills.example.com", "adult-x.example.net"]


def url_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    listed = " or ".join(f"host = '{h}' or ends_with(host, '.{h}')" for h in LISTED_HOSTS)
    return f"""
with rules(h, p, v) as (values {rules}),
parts as (select page_id, url,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') as path from pages),
urls as (select distinct host, path from parts),
best as (select host, path, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as v
    from urls join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by 1, 2)
select page_id, parts.host as host, parts.path as path, rule, coalesce(v, case when {listed.replace('host', 'parts.host')} then 'block' else 'allow' end) as verdict
from parts left join best on parts.host = best.host and parts.path = best.path"""


@query("op1_url_filter", url_sql())
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Every page judged by the rules; where none fits, by the listed hosts."""
    shape = "host string, path string, verdict string"
    pages = table(spark, folder, "pages").select("page_id", "url")
    ruled = url_filter.judge(pages, spark.createDataFrame(URL_RULES, shape), default=None)
    listed = url_filter.judge(ruled, spark.createDataFrame([(h, "", "block") for h in LISTED_HOSTS], shape), prefix="listed_")
    return listed.select("page_id", "host", "path", "rule", F.coalesce("verdict", "listed_verdict").alias("verdict"))


@query("op5_ngram_jaccard")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its set size and component at 90 of 100 over 3-word runs."""
    return jaccard.jaccard_components(table(spark, folder, "documents"), k=3, percent=90)


@query("op6_ogg_media")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Every text stored as an Ogg column and read back."""
    docs = table(spark, folder, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    media = ogg.with_media(docs, "text").select("doc_id", "n_bytes", "media")
    return ogg.read_media(media, ["doc_id", "n_bytes"], payload=False).drop("ok")


#: target weights of the mix; sources not named share the last
MIX = {"src0": 4, "src1": 3, "src2": 3, "src3": 2, "src4": 2, "*": 10}
MIX_BLOCK = 8


def mix_sql(documents: str = "documents", select: str = "doc_id") -> str:
    order = sorted(MIX, key=lambda s: (-MIX[s], s))
    rows = ", ".join(f"({i + 1}, '{s}', {MIX[s]})" for i, s in enumerate(order))
    named = ", ".join(f"'{s}'" for s in MIX if s != "*")
    return f"""
with recursive w(o, source, q) as (values {rows}),
slots(slot, done, pick, qs, p) as (
  select cast(-1 as bigint), list_transform(list(q order by o), lambda x: cast(0 as bigint)), cast(0 as bigint), list(cast(q as bigint) order by o), cast(sum(q) as bigint) from w
  union all
  select slot + 1, list_transform(range(1, len(qs) + 1), lambda i: done[i] + case when i = b then 1 else 0 end), b, qs, p
  from (select slot, done, qs, p, list_sort(list_transform(range(1, len(qs) + 1), lambda i: {{'d': case when (done[i] * p) // qs[i] <= slot + 1
      then ((done[i] + 1) * p + qs[i] - 1) // qs[i] else 1000000000 end, 'i': i}}))[1].i as b from slots where slot + 1 < p)),
plan as (select source, cast(q as bigint) as q, p, row_number() over (partition by source order by slot) - 1 as turn, slot
  from slots join w on pick = o),
ranked as (select *, case when source in ({named}) then source else '*' end as mix_source from {documents}),
numbered as (select *, row_number() over (partition by mix_source order by md5(coalesce(cast(doc_id as varchar), '')), md5(coalesce(text, ''))) - 1 as mix_rank from ranked),
ends as (select min((b // q) * p + slot) as e from (
  select plan.*, coalesce(c, 0) as b from plan left join (select mix_source, (count(*) + {MIX_BLOCK} - 1) // {MIX_BLOCK} as c from ranked group by 1) t on t.mix_source = plan.source)
  where b % q = turn)
select {select}, mix_source, mix_rank, mix_rank // {MIX_BLOCK} as mix_block, (mix_rank // {MIX_BLOCK} // q) * p + slot as mix_slot,
  (mix_rank // {MIX_BLOCK} * p) // q as mix_release, ((mix_rank // {MIX_BLOCK} + 1) * p + q - 1) // q as mix_deadline,
  (mix_rank // {MIX_BLOCK} // q) * p + slot < e as mix_in
from numbered join plan on plan.source = mix_source and turn = (mix_rank // {MIX_BLOCK}) % q cross join ends"""


@query("op4_source_mix", mix_sql())
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its place in the mix."""
    return mixing.mix_sources(table(spark, folder, "documents"), MIX, MIX_BLOCK, keep=["doc_id"])


DECONTAMINATION_SQL = """
with d as (select distinct doc_id, text from documents where doc_id is not null),
dw as (select doc_id, text, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from d),
ds as (select doc_id, text, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:least(i + 4, len(w))], ' ')))) as run from dw where len(w) > 0),
i as (select distinct item_id, text as item from benchmark),
iw as (select item_id, item, list_filter(regexp_split_to_array(translate(coalesce(item, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from i),
il as (select item_id, item, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:least(i + 4, len(w))], ' '))) as runs from iw where len(w) > 0),
r as (select item_id, item, len(runs) as size, unnest(runs) as run from il),
p as (select doc_id, text, item_id, item, size, count(*) as shared from ds join r using (run) group by all)
select doc_id, item_id, max(size) as item_runs, max(shared) as shared, max(shared / size) as containment from p where shared * 100 >= size * 80 group by 1, 2"""


@query("op7_benchmark_decontamination", DECONTAMINATION_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of a document and a benchmark item of which it holds 80 of 100 runs."""
    return decontaminate.pairs(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op9_license_scan")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its license phrases, labels and verified spans' score."""
    return licenses.scan(table(spark, folder, "documents")).drop("spans")


@query("op2_toxicity")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's toxicity; rows whose id's crc32 leaves 1 of 3 are held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rest = crc_rest(F.col("doc_id"), 3)
    model = toxicity.fit(docs, table(spark, folder, "labels"), rest != 1)
    held = F.coalesce(rest == 1, F.lit(False)).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op3_quality_neighbours")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's quality; rows whose id's crc32 leaves 0 of 5 are held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rest = crc_rest(F.col("doc_id"), 5)
    model = quality.fit(docs, table(spark, folder, "labels"), rest != 0)
    held = F.coalesce(rest == 0, F.lit(False)).alias("held_out")
    return quality.score(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op8_main_text")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's main text."""
    pages = template.extract(table(spark, folder, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op10_attention_lm")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's log10 probability; rows whose id's crc32 leaves 0 of 10 are held out."""
    held = crc_rest(F.col("doc_id"), 10) == 0
    scored = attention_lm.score_documents(table(spark, folder, "documents").select("doc_id", "text"), held)
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op11_secret_scan", secret_scan.scan_sql())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its counts of the base kinds, the hash of their spans and all spans."""
    return secret_scan.scan(table(spark, folder, "documents"))


@query("op12_embedding_whitening")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding on the 16 leading components of the distinct vectors' covariance, whitened."""
    return whitening.whiten(table(spark, folder, "embeddings"))


@query("op13_merkle_manifest")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's leaf, proof and the root that its (sometimes tampered) proof folds to."""
    return merkle.of_documents(table(spark, folder, "documents"))
