"""Search, similarity, redaction, compression and code queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code, text
from ..operators import context, fragments, graph, search, traverse
from ..registry import query
from ..sources.samples import files, path_sql
from ..sources.tables import table
from ..operators.keep import keep, spread

#: Texts without licence lines, line ends and blank lines, as the oracle says it; no document has a badge or an install section.
BARE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?im)^(?:#|//|<!--).*?(?:Copyright|License|SPDX).*\n(?:(?:#|//|<!--).*\n)*', '', 'g'), '^\n+', ''), '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
BM25 = ("the", "of", "stupid")
_TERMS = ", ".join(f"'{w}'" for w in BM25)


@query(f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents), n AS (SELECT doc_id, len(w) AS n FROM t), s AS (SELECT count(*) AS docs, avg(n) AS avg FROM n),
h AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM t) WHERE term IN ({_TERMS}) GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM h GROUP BY term)
SELECT doc_id AS id, round(sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avg))) * CASE WHEN count(DISTINCT term) = {len(BM25)} THEN 1.5 ELSE 1.0 END, 6) AS score
FROM h JOIN f USING (term) JOIN n USING (doc_id), s GROUP BY doc_id ORDER BY score DESC, id LIMIT 10""")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return search.bm25(docs, list(BM25))


@query("""SELECT b.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY score DESC, b.vec_id LIMIT 15""")
def embed_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return search.dense_top_k(e, e.where("vec_id = 0"))


CENTRES = "centres AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY label, i) GROUP BY label)"


@query(f"WITH {CENTRES}, d AS (SELECT e.vec_id, e.label, c.label AS near, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), c.c), 5) AS s FROM embeddings e, centres c) SELECT label, near, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, near) AS rn FROM d) WHERE rn = 1 GROUP BY label, near")
def embed_label_confusion(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("c"))
    every = centres.agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("cs"))  # one row: a centre for each label
    scored = e.crossJoin(F.broadcast(every)).withColumn("s", F.transform("cs", lambda p: F.struct((-F.round(search.dot(F.col("embedding"), p["c"]), 5)).alias("neg"), p["label"].alias("near"))))
    return scored.select("label", F.array_min("s")["near"].alias("near")).groupBy("label", "near").agg(F.count("*").alias("n"))


#: Least similarity at which a stored question's answer stands for another's.
FUZZY = 0.8
KEY = "substr(md5(lower(trim(text))), 1, 12)"


@query(f"WITH cache AS (SELECT {KEY} AS key, min(conv_id) AS first_conv, count(*) AS hits FROM conversations WHERE role = 'user' GROUP BY 1) SELECT key, first_conv, hits FROM cache")
def query_cache_exact(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").where("role = 'user'").groupBy(search.question_key(F.col("text")).alias("key")).agg(F.min("conv_id").alias("first_conv"), F.count("*").alias("hits"))


ASKED = """q AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE role = 'user' UNION ALL SELECT 1000000000 + conv_id * 1000 + turn, text || ' please' FROM conversations WHERE role = 'user' AND conv_id % 2 = 0
UNION ALL SELECT 2000000000 + conv_id * 1000 + turn, 'zz yy xx ' || text FROM conversations WHERE role = 'user' AND conv_id % 3 = 0)"""


@query(f"""WITH {ASKED}, w AS (SELECT id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM q),
p AS (SELECT a.id, b.id AS key, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS j FROM w a JOIN w b ON b.id < a.id WHERE len(a.w) > 0 AND len(b.w) > 0)
SELECT id, key, round(j, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY j DESC, key) AS rn FROM p WHERE j >= {FUZZY}) WHERE rn = 1""")
def query_cache_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    """Questions, and the same with words added, each against those before it."""
    q = table(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", "conv_id")
    more = q.where("conv_id % 2 = 0").select((F.col("id") + 1_000_000_000).alias("id"), F.concat("text", F.lit(" please")).alias("text"))
    most = q.where("conv_id % 3 = 0").select((F.col("id") + 2_000_000_000).alias("id"), F.concat(F.lit("zz yy xx "), "text").alias("text"))
    w = q.select("id", "text").unionByName(more).unionByName(most).select("id", search.question_words(F.col("text")).alias("w"))
    return search.earlier_match(w, FUZZY)


_any = lambda words, c="lower(text)": " OR ".join(f"contains({c}, '{w}')" for w in words)


@query(r"""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)overview|what does this project|architecture|high level|overall|what is this|kya hai ye project|repo ke baare') THEN 'repo'
WHEN regexp_matches(text, '(?i)module|community|cluster|layer|service|package|component|subsystem|how are|organized') THEN 'community' WHEN regexp_matches(text, '(?i)\.py|\.ts|\.js|\.go|\.rs|file|class|interface|import|depend') THEN 'module' ELSE 'symbol' END AS level
FROM (SELECT conv_id, turn, text || CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN ' Overall' ELSE ' which FILE' END AS text FROM conversations)""")
def level_route(spark: SparkSession, sf: str) -> DataFrame:
    tail = F.when(F.col("turn") % 4 == 0, "").when(F.col("turn") % 4 == 1, " Overall").otherwise(" which FILE")
    return table(spark, sf, "conversations").select("conv_id", "turn", context.level(F.concat("text", tail)).alias("level"))


TIERS = {"tier0_cache": ("[cached]", "cache hit", "(from cache)"), "tier1_deterministic": ("community", "cluster"), "tier2_embedding": ("embedding", "similar", "cosine"), "tier3_subgraph": ("subgraph", "[llm]"), "tier1_graph": ("results for:",), "tier1_stats": ("token", "savings", "queries", "nodes", "edges")}
_TIER = "CASE " + " ".join(f"WHEN {_any(w, 'lower(substr(text, 1, 300))')} THEN '{k}'" for k, w in TIERS.items()) + " ELSE 'tier_unknown' END"


_WORDS = ", ".join(f"({i}, '{k}', '{w}')" for i, (k, ws) in enumerate(TIERS.items()) for w in ws)


@query(f"""WITH w AS (SELECT * FROM (VALUES {_WORDS}) t(place, tier, word)), m AS (SELECT conv_id, turn, arg_min(tier, place) AS tier FROM conversations JOIN w ON position(word IN lower(left(text, 300))) > 0 WHERE role = 'assistant' GROUP BY conv_id, turn)
SELECT conv_id, turn, COALESCE(tier, 'tier_unknown') AS tier FROM conversations LEFT JOIN m USING (conv_id, turn) WHERE role = 'assistant'""")
def tier_classify(spark: SparkSession, sf: str) -> DataFrame:
    """The tier that each answer came from, by the first list of words that it has one of; the oracle joins the words."""
    return table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.expr(_TIER).alias("tier"))


@query("SELECT tier, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM (SELECT CAST(length(text) // 4 AS BIGINT) AS tokens, CASE WHEN length(text) // 4 < 1500 THEN 'cheap' WHEN length(text) // 4 < 8000 THEN 'medium' ELSE 'cloud' END AS tier FROM documents) GROUP BY tier")
def model_route(spark: SparkSession, sf: str) -> DataFrame:
    n = text.token_estimate(F.col("text"))
    tier = F.when(n < 1500, "cheap").when(n < 8000, "medium").otherwise("cloud")
    return table(spark, sf, "documents").select(n.alias("tokens"), tier.alias("tier")).groupBy("tier").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


@query("SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT lang, count(*) AS docs, CAST(sum(least(length(text) // 4 + 50, 40000)) AS BIGINT) AS tokens, round(sum(least(length(text) // 4 + 50, 40000)) * 3.0 / 1e6, 6) AS usd FROM documents GROUP BY lang")
def doc_batches_cost(spark: SparkSession, sf: str) -> DataFrame:
    n = F.least(text.token_estimate(F.col("text")) + 50, F.lit(40000))
    return table(spark, sf, "documents").withColumn("t", n).groupBy("lang").agg(F.count("*").alias("docs"), F.sum("t").alias("tokens"), F.round(F.sum("t") * 3.0 / 1e6, 6).alias("usd"))


@query("""WITH RECURSIVE s AS (SELECT doc_id AS id, CAST(length(text) // 4 + 50 AS BIGINT) AS t, row_number() OVER (ORDER BY length(text) // 4 + 50 DESC, doc_id) AS i FROM documents),
r AS (SELECT i, id, t AS used, CAST(0 AS BIGINT) AS batch FROM s WHERE i = 1 UNION ALL SELECT s.i, s.id, CASE WHEN r.used + s.t <= 12000 THEN r.used + s.t ELSE s.t END, CASE WHEN r.used + s.t <= 12000 THEN r.batch ELSE r.batch + 1 END FROM r JOIN s ON s.i = r.i + 1) SELECT id, batch FROM r""")
def bin_pack(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (text.token_estimate(F.col("text")) + 50).alias("tokens"))
    return search.next_fit(docs, 12_000)


@query("SELECT sha256(text) AS hash, min(doc_id) AS representative, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dups(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("hash")).agg(F.min("doc_id").alias("representative"), F.count("*").alias("copies")).where("copies > 1")


@query("SELECT count(*) AS files, count(DISTINCT text) AS representatives, count(*) - count(DISTINCT text) AS calls_saved, round((count(*) - count(DISTINCT text)) * 100.0 / count(*), 2) AS savings_pct FROM documents")
def dedup_rollup(spark: SparkSession, sf: str) -> DataFrame:
    by = table(spark, sf, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256)).agg(F.count("*").alias("n"))
    files, kinds = F.sum("n"), F.count("*")
    return by.agg(files.alias("files"), kinds.alias("representatives"), (files - kinds).alias("calls_saved"), F.round((files - kinds) * 100.0 / files, 2).alias("savings_pct"))


SIMILAR = """w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM documents), g AS (SELECT id, CASE WHEN len(t) >= 4 THEN list_distinct([array_to_string(t[i:i + 3], ' ') FOR i IN range(1, len(t) - 2)]) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] END AS s FROM w),
u AS (SELECT id, len(s) AS n, unnest(s) AS x FROM g), pairs AS (SELECT a, b FROM (SELECT p.id AS a, q.id AS b, count(*) AS c, max(p.n) AS na, max(q.n) AS nb FROM u p JOIN u q ON p.x = q.x AND p.id < q.id GROUP BY 1, 2) WHERE c / (na + nb - c) >= 0.82)"""
_LABELS = "l0 AS (SELECT id, id AS c FROM w), " + ", ".join(f"l{i} AS (SELECT a.id, min(least(a.c, COALESCE(b.c, a.c))) AS c FROM l{i - 1} a LEFT JOIN (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs) e ON e.x = a.id LEFT JOIN l{i - 1} b ON b.id = e.y GROUP BY a.id)" for i in range(1, 7))


def _similar(spark: SparkSession, sf: str) -> DataFrame:
    """The group of each document: rows of equal shingle sets first, then linked sets."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("long").alias("id"), "text")
    some = lambda ids: search.hashed_shingles(search.fetched(d, ids))
    sets = search.hashed_shingles(d)
    docs = keep(sets.select("id", F.size("s").alias("n"), F.sha2(F.array_join("s", ",").cast("binary"), 256).alias("h")))
    lead = keep(docs.where("n > 0").groupBy("h").agg(F.min("id").alias("id")))
    pairs = keep(search.similar_pairs(sets, 0.82, some, lead.select("id")))
    groups = traverse.connected_components(lead.select("id"), pairs.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    named = docs.select("id", "h").join(lead.select("h", F.col("id").alias("lead")), "h", "left").join(groups.select(F.col("id").alias("lead"), "component"), "lead", "left")
    return named.select("id", F.coalesce("component", "id").alias("component"))


@query(f"WITH {SIMILAR}, {_LABELS} SELECT id AS doc_id, c AS component FROM l6")
def minhash_lsh(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of near duplicates: a row for each document with the smallest id of its group."""
    return _similar(spark, sf).select(F.col("id").alias("doc_id"), "component")


@query(f"WITH {SIMILAR}, {_LABELS}, m AS (SELECT c, count(*) AS members FROM l6 GROUP BY c HAVING count(*) > 1), r AS (SELECT c, id, row_number() OVER (PARTITION BY c ORDER BY length(text) DESC, id) AS rn FROM l6 JOIN documents ON doc_id = id) SELECT c AS component, id AS representative, members, true AS similar FROM m JOIN r USING (c) WHERE rn = 1")
def near_dups_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Representative and size of each group; similar: whether the average similarity of its pairs, as 128 hashes estimate it, is high."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("long").alias("id"), "text")
    groups = keep(_similar(spark, sf))
    members = keep(groups.join(groups.groupBy("component").agg(F.count("*").alias("m")).where("m > 1").drop("m"), "component"))
    tasks = spread(spark, members.count(), 2000)  # a set has 128 hashes taken of each of its words
    sets = search.hashed_shingles(search.fetched(d, members.select("id"), tasks))  # texts are dealt out, and no set: hashes of a set are fewer than its words
    signed = keep(members.join(sets.select("id", "chars", search.minhash(F.col("s"), search.HASHES).alias("h")), "id"))
    r = search.representatives(signed)
    return r.select("component", "representative", "members", (F.col("similarity") > 0.7).alias("similar"))


@query(f"""SELECT replace({path_sql('python')}, 'supplier_', 'copy_') || CASE i WHEN 0 THEN '' WHEN 1 THEN '::Supplier' || CAST(s_suppkey AS STRING) ELSE '::call_' || CAST(s_suppkey AS STRING) END AS id FROM supplier, range(3) t(i)""")
def projected_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """What was extracted of a representative, put down for its duplicate: the one's stem becomes the other's."""
    d = files(spark, sf, "python")
    own = fragments.source(d).bare().nodes.where("file is not null")
    stem = code.stem(F.col("path"))
    pairs = d.select(F.col("path").alias("file"), stem.alias("old"), F.regexp_replace(stem, "supplier_", "copy_").alias("new"))
    return graph.project(own, pairs).select("id")


#: The rules whose patterns the oracle's engine can read: all but the two with look-around or a back reference.
READABLE = tuple(r for r in text.RULES if r[0] not in ("aws_secret_key", "password_assignment"))
_q = lambda x: x.replace("'", "''")
_to = lambda x: re.sub(r"\$(\d)", r"\\\1", x)
#: What is put behind a text, by doc_id, so that every rule has something to find (made up, and put together here).
PLANTED = {
    0: "sk-' || repeat('a1', 12) || '", 1: "sk-ant-' || repeat('a-1', 8) || '", 2: "ghp_' || repeat('aB1', 13) || '", 3: "sk_live_' || repeat('x9', 13) || '", 4: "pk_test_' || repeat('x9', 13) || '",
    5: "AIza' || repeat('q', 36) || '", 6: "SG.' || repeat('a', 22) || '.' || repeat('b', 43) || '", 7: "xoxb-' || repeat('12', 8) || '", 8: "SK' || repeat('0f', 16) || '",
    9: "-----BEGIN RSA PRIVATE KEY-----' || chr(10) || 'abc' || chr(10) || '-----END RSA PRIVATE KEY-----", 10: "' || chr(10) || 'API_KEY=' || repeat('zq', 6) || '", 11: "postgres://joe:pw@host",
    12: "eyJ' || repeat('ab', 12) || '.' || repeat('cd', 12) || '.' || repeat('ef', 12) || '", 13: "token = ' || repeat('0a', 20) || '", 14: "cert: ' || repeat('QUJD', 8) || '", 15: "me@site.org", 16: "10.0.0.1",
}
SECRETS = "(text || ' ' || CASE doc_id % 20 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in PLANTED.items()) + " ELSE '' END)"


def _stages(rules: tuple) -> str:
    parts = [f"t0 AS (SELECT doc_id, {SECRETS} AS t FROM documents)"]
    parts += [f"t{i + 1} AS (SELECT doc_id, regexp_replace(t, '{_q(p)}', '{_to(to)}', 'g') AS t FROM t{i})" for i, (_, p, to) in enumerate(rules)]
    return ", ".join(parts)


def _secrets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.expr(SECRETS).alias("text"))


EVERY = (*READABLE, *text.OPTIONAL_RULES)


@query(f"WITH {_stages(EVERY)} " + " UNION ALL ".join(f"SELECT '{n}' AS rule, CAST(sum(len(regexp_extract_all(t, '{_q(p)}'))) AS BIGINT) AS n FROM t{i}" for i, (n, p, _) in enumerate(EVERY)))
def privacy_counts(spark: SparkSession, sf: str) -> DataFrame:
    hits = _secrets(spark, sf).select(F.explode(text.rule_counts(F.col("text"), EVERY)).alias("r"))
    return hits.groupBy("r.rule").agg(F.sum("r.n").alias("n"))


@query(f"WITH {_stages(EVERY)} SELECT doc_id, sha256(t) AS hash FROM t{len(EVERY)}")
def privacy_scrub(spark: SparkSession, sf: str) -> DataFrame:
    return _secrets(spark, sf).select("doc_id", F.sha2(text.scrub(F.col("text"), EVERY).cast("binary"), 256).alias("hash"))


@query(f"WITH {_stages(READABLE)} " + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) AS events, CAST(sum(n) AS BIGINT) AS total, count(DISTINCT doc_id) AS files FROM (SELECT doc_id, len(regexp_extract_all(t, '{_q(p)}')) AS n FROM t{i}) WHERE n > 0 HAVING count(*) > 0" for i, (n, p, _) in enumerate(READABLE)))
def privacy_audit(spark: SparkSession, sf: str) -> DataFrame:
    hits = _secrets(spark, sf).select("doc_id", F.explode(text.rule_counts(F.col("text"), READABLE)).alias("r")).where("r.n > 0")
    return hits.groupBy("r.rule").agg(F.count("*").alias("events"), F.sum("r.n").alias("total"), F.countDistinct("doc_id").alias("files"))


@query(f"SELECT doc_id FROM (SELECT doc_id, {SECRETS} AS t FROM documents) WHERE " + " OR ".join(f"regexp_matches(t, '{_q(p)}')" for _, p, _ in READABLE))
def has_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return _secrets(spark, sf).where(text.has_secrets(F.col("text"), READABLE)).select("doc_id")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT doc_id, line, count(*) AS n FROM l WHERE trim(line) <> '' AND length(line) < 80 GROUP BY 1, 2 HAVING count(*) >= 3) SELECT doc_id, count(*) AS lines, CAST(sum(n) AS BIGINT) AS removed FROM c GROUP BY doc_id""")
def repeated_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> '' and length(line) < 80")
    often = lines.groupBy("doc_id", "line").agg(F.count("*").alias("n")).where("n >= 3")
    return often.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum("n").alias("removed"))


@query("SELECT doc_id, length(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g')) AS n FROM documents")
def collapse_blank(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.length(text.collapse_blank(F.col("text"))).cast("long").alias("n"))


@query(f"SELECT lang, CAST(sum(length(text)) AS BIGINT) AS before, CAST(sum(length({BARE})) AS BIGINT) AS after, round((1 - sum(length({BARE})) / sum(length(text))) * 100, 4) AS saved_pct FROM documents GROUP BY lang")
def doc_compress_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("lang", F.length("text").alias("n"), F.length(text.compressed(F.col("text"))).alias("c"))
    return d.groupBy("lang").agg(F.sum("n").alias("before"), F.sum("c").alias("after"), F.round((1 - F.sum("c") / F.sum("n")) * 100, 4).alias("saved_pct"))


@query("SELECT doc_id, regexp_extract(regexp_replace(trim(text), '\\s+', ' ', 'g'), '^([^.!?]{5,150}[.!?])', 1) AS sentence FROM documents")
def first_sentence(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.first_sentence(F.col("text")).alias("sentence"))


@query("SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages) GROUP BY page_id, link")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.explode(text.links(F.col("html"))).alias("link")).groupBy("page_id", "link").agg(F.count("*").alias("n"))


_STEM = "CASE s_suppkey % 3 WHEN 0 THEN 'supplier_' WHEN 1 THEN 'test_supplier_' ELSE 'auth_' END || CAST(s_suppkey AS STRING)"
_ABOUT = "['what does ' || s || ' do?', 'who calls functions in ' || s || '?'"
_AUTH = "['how does authentication work?', 'what is the auth flow?', 'which files handle user sessions?', 'what handles login?']"


@query(f"""WITH f AS (SELECT s_suppkey % 3 AS k, {_STEM} AS s, replace({_STEM}, 'test_', '') AS bare FROM supplier),
q AS (SELECT s, CASE k WHEN 1 THEN {_ABOUT.replace('|| s ||', '|| bare ||')}, 'which files have test coverage?'] ELSE [] END || {_ABOUT}, 'what does ' || s || ' depend on?'] || CASE k WHEN 2 THEN {_AUTH} ELSE [] END AS q FROM f)
SELECT 'scm/' || s || '.py' AS path, i - 1 AS pos, q[i] AS question FROM q, LATERAL (SELECT unnest(range(1, len(q) + 1)) AS i)""")
def predict_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Likely questions about suppliers' files, of which some are tests and some about signing in."""
    path = table(spark, sf, "supplier").select(F.concat(F.lit("scm/"), F.expr(_STEM), F.lit(".py")).alias("path"))
    return path.select("path", F.posexplode(code.predicted_questions(F.col("path"))).alias("pos", "question"))
