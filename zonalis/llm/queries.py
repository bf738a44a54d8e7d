"""The operators as queries over the driver's tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import core, crf, licenses, link_trust, suffix_tree, toxicity, warc
from .decontaminate import decontaminate
from .minhash_join import near_duplicates
from .packing import pack
from .subspace_join import links


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(column: str, n: int) -> Column:
    """crc32 of an id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def toxicity_weights(docs: DataFrame, labels: DataFrame) -> toxicity.Weights:
    """Learned from the rows of ``labels`` that are not held out."""
    return toxicity.train(docs, labels.where(_remainder("doc_id", 3) != 1))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document's score; a third of the ids is held out of the training."""
    docs = table(spark, sf_dir, "documents")
    weights = toxicity_weights(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), weights)
    return scored.select("doc_id", (_remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document's log10 probability; a tenth of the ids is held out of the tree."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tree = suffix_tree.grow(docs.where(_remainder("doc_id", 10) != 0), depth=None)
    out = suffix_tree.score(docs, tree)
    return out.select("doc_id", (_remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(tree.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose 2-word shingle sets are similar by 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


#: Verdict, host and path of each URL rule; the hosts are whole or parent domains.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict by rule, else by its host's trust and distrust."""
    return link_trust.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives with revisits, and read back from them."""
    path = core.new_path(spark, "warc")
    warc.write(warc.resolve(table(spark, sf_dir, "pages")), path)
    rows = warc.summary(warc.read(spark, path))
    return rows.select(F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with a cosine of 0.9 or more."""
    return links(table(spark, sf_dir, "embeddings"))


def language_model(docs: DataFrame) -> crf.Model | None:
    """Learned from the documents that are not held out."""
    return crf.train(docs.where(_remainder("doc_id", 4) != 2))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document's language; a quarter of the ids is held out of the training."""
    docs = table(spark, sf_dir, "documents")
    found = crf.predict(docs.select("doc_id", "text"), language_model(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", (_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


_SHORT = 400


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents as files ``source/thousand/hundred/id.txt``; those of at most
    400 characters are the notices of their thousand's directory."""
    c = F.col
    top = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.floor(c("doc_id") / 1000).cast("string"))
    path = F.when(F.length("text") <= _SHORT, F.concat(top, F.lit("/NOTICE-"), c("doc_id").cast("string"))).otherwise(F.concat(top, F.lit("/"), F.floor(c("doc_id") / 100).cast("string"), F.lit("/"), c("doc_id").cast("string"), F.lit(".txt")))
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return licenses.scan(files, "doc_id", "path", "text")


_FILES_SQL = f"""SELECT doc_id AS file_id, text, CASE
    WHEN length(text) <= {_SHORT} THEN coalesce(source, '_') || '/' || (doc_id // 1000) || '/NOTICE-' || doc_id
    ELSE coalesce(source, '_') || '/' || (doc_id // 1000) || '/' || (doc_id // 100) || '/' || doc_id || '.txt' END AS path
  FROM documents"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens, mixed by source."""
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items whose windows they hold."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return contaminated(found)


def contaminated(found: DataFrame) -> DataFrame:
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_suffix_tree": op2_suffix_tree,
    "op3_minhash": op3_minhash,
    "op4_url_filter": op4_url_filter,
    "op5_packing": op5_packing,
    "op6_embeddings": op6_embeddings,
    "op7_warc": op7_warc,
    "op8_decontamination": op8_decontamination,
    "op9_language": op9_language,
    "op10_license_scan": op10_license_scan,
}

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = """reach(a, b) AS (SELECT a, b FROM pair UNION SELECT b, a FROM pair UNION SELECT reach.a, p.b FROM reach JOIN (SELECT a, b FROM pair UNION SELECT b, a FROM pair) p ON reach.b = p.a),
comp AS (SELECT a, min(b) AS m FROM reach GROUP BY 1)"""


def _url_sql() -> str:
    rules = sorted(URL_RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN " for _, h, p in rules]
    rule = " ".join(f + f"'{h}{p}'" for f, (_, h, p) in zip(fits, rules, strict=True))
    verdict = " ".join(f + f"'{v}'" for f, (v, _, _) in zip(fits, rules, strict=True))
    d = link_trust.DAMPING
    rounds = "".join(f""",
r{i + 1} AS MATERIALIZED (SELECT kind, host, coalesce(m, 0) + {1 - d!r}::DOUBLE * coalesce(s, 0) AS r FROM (SELECT w.kind, w."to" AS host, sum(r * p) * {d}::DOUBLE AS m FROM walk w JOIN r{i} USING (kind, host) GROUP BY 1, 2) FULL JOIN seed USING (kind, host))""" for i in range(link_trust.ROUNDS))
    link = link_trust.LINK.replace("'", "''")
    return f"""WITH cut AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, html, {_FOLD.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS verdict FROM split),
host AS (SELECT host, count(*) AS n, count(CASE WHEN verdict = 'allow' THEN 1 END) AS good, count(CASE WHEN verdict = 'block' THEN 1 END) AS bad FROM ruled WHERE host <> '' GROUP BY 1),
link AS (SELECT host, "to", count(*) AS w FROM (SELECT page_id, host, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), '{link}', 1), lambda x: {_FOLD.format('x')}))) AS "to" FROM ruled WHERE host <> '') WHERE host <> "to" GROUP BY 1, 2),
edge AS (SELECT host, "to", w FROM link UNION ALL SELECT host, host, 1 FROM host UNION ALL SELECT DISTINCT "to", "to", 1 FROM link WHERE "to" NOT IN (SELECT host FROM host)),
both_ways AS (SELECT 'trust' AS kind, host, "to", w FROM edge UNION ALL SELECT 'distrust', "to", host, w FROM edge),
walk AS MATERIALIZED (SELECT kind, host, "to", w / sum(w) OVER (PARTITION BY kind, host) AS p FROM both_ways),
seed AS MATERIALIZED (SELECT 'trust' AS kind, host, good / n AS s FROM host WHERE good > 0 UNION ALL SELECT 'distrust', host, bad / n FROM host WHERE bad > 0),
r0 AS (SELECT kind, host, s AS r FROM seed){rounds},
score AS (SELECT host, max(CASE WHEN kind = 'trust' THEN r END) AS trust, max(CASE WHEN kind = 'distrust' THEN r END) AS distrust FROM r{link_trust.ROUNDS} GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN round(coalesce(distrust, 0), {link_trust.DIGITS}) > round(coalesce(trust, 0), {link_trust.DIGITS}) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN score USING (host)"""


ORACLE_SQL: dict[str, str] = {
    "op3_minhash": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS x FROM w)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM sh p JOIN sh q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY 1, 2),
pair AS (SELECT a, b FROM common JOIN size s ON s.doc_id = a JOIN size t ON t.doc_id = b WHERE 100 * c >= 80 * (s.n + t.n - c)),
{_REACH}
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM documents LEFT JOIN size USING (doc_id) LEFT JOIN comp ON a = doc_id""",
    "op4_url_filter": _url_sql(),
    "op6_embeddings": f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
pair AS (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.vec_id < q.vec_id AND len(p.e) = len(q.e) WHERE list_dot_product(p.e, q.e) / (p.n * q.n) >= 0.9),
deg AS (SELECT a, count(*) AS n FROM (SELECT a FROM pair UNION ALL SELECT b FROM pair) GROUP BY 1),
{_REACH}
SELECT vec_id, coalesce(deg.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN deg ON deg.a = vec_id LEFT JOIN comp ON comp.a = vec_id""",
    "op8_decontamination": f"""WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, ws[i:i + least(len(ws), 10) - 1] AS x FROM (SELECT *, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)),
dwin AS (SELECT doc_id, i, n, ws[i:i + n - 1] AS x FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)),
hit AS (SELECT doc_id, item_id, i, n FROM dwin JOIN win USING (n, x)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op7_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT payload_digest, min(page_id) AS original FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM p LEFT JOIN o USING (payload_digest)""",
    "op10_license_scan": f"SELECT file_id AS doc_id, * EXCLUDE (file_id) FROM ({licenses.oracle(_FILES_SQL)})",
}
