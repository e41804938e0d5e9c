"""What parsers find in file contents made from the tables (`sources.samples`); the oracle says it from the columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code, text
from ..operators import fragments, git, guard, importance, packages, parse, types
from ..operators.build import build_packages
from ..operators.keep import spread
from ..registry import query
from ..sources import files as source
from ..sources.samples import SAMPLES, files, path_sql, sql
from ..sources.tables import table

PY, TS, MD = path_sql("python"), path_sql("typescript"), path_sql("markdown")
K = "CAST(s_suppkey AS STRING)"
P = "CAST(p_partkey AS STRING)"


def _code(spark: SparkSession, sf: str) -> fragments.Fragments:
    return fragments.source(files(spark, sf, "python", "typescript")).bare()


CODE_NODES = f"""WITH py AS (SELECT {PY} AS path, {K} AS k, CAST(s_nationkey AS STRING) AS n FROM supplier), ts AS (SELECT {TS} AS path, {P} AS k FROM part)
SELECT path AS id, 'supplier_' || k AS label, 'module' AS type, 'python module: supplier_' || k AS summary FROM py UNION ALL SELECT path || '::Supplier' || k, 'Supplier' || k, 'class', 'python class in supplier_' || k FROM py
UNION ALL SELECT path || '::call_' || k, 'call_' || k, 'function', 'python function in supplier_' || k FROM py
UNION ALL SELECT path, 'part_' || k, 'module', 'typescript module: part_' || k FROM ts UNION ALL SELECT path || '::Item' || k, 'Item' || k, 'class', 'typescript class in part_' || k FROM ts
UNION ALL SELECT path || '::Part' || k, 'Part' || k, 'interface', 'typescript interface/type in part_' || k FROM ts UNION ALL SELECT path || '::price' || k, 'price' || k, 'function', 'typescript function in part_' || k FROM ts
UNION ALL SELECT DISTINCT 'pkg:' || p, p, 'external', 'External package: ' || p FROM (SELECT 'nation_' || n AS p FROM py UNION ALL SELECT unnest(['os', 'react', '@scope/kit']))"""


@query(CODE_NODES)
def code_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _code(spark, sf).nodes.select("id", "label", "type", "summary")


@query(f"""WITH py AS (SELECT {PY} AS path, {K} AS k, CAST(s_nationkey AS STRING) AS n FROM supplier), ts AS (SELECT {TS} AS path, {P} AS k, substr(p_brand, 7) AS b FROM part)
SELECT path AS src, path || '::' || d AS dst, 'defines' AS relation FROM (SELECT path, unnest(['Supplier' || k, 'call_' || k]) AS d FROM py UNION ALL SELECT path, unnest(['Item' || k, 'Part' || k, 'price' || k]) FROM ts)
UNION ALL SELECT path || '::Supplier' || k, 'Nation', 'extends' FROM py UNION ALL SELECT path || '::Item' || k, 'Base', 'extends' FROM ts
UNION ALL SELECT path, unnest(['pkg:os', 'pkg:nation_' || n, 'scm/n' || n || '/..shared']), 'imports' FROM py UNION ALL SELECT path, unnest(['parts/b' || b || '/brand', 'pkg:react', 'pkg:@scope/kit']), 'imports' FROM ts""")
def code_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _code(spark, sf).edges


@query(f"""SELECT {PY} || '::call_' || {K} AS key, '(amount: int, rate: float) -> str' AS signature FROM supplier UNION ALL SELECT {TS} || '::price' || {P}, '(x: number): string' FROM part""")
def type_signatures(spark: SparkSession, sf: str) -> DataFrame:
    d = files(spark, sf, "python", "typescript")
    return types.python_types(d).unionByName(types.typescript_types(d))


@query(f"""SELECT {PY} || '::call_' || {K} AS id, 'python function in supplier_' || {K} || ' | sig: (amount: int, rate: float) -> str' AS summary FROM supplier
UNION ALL SELECT 'x::' || {K}, 'other | sig: (amount: int, rate: float) -> str' FROM supplier""")
def type_enriched(spark: SparkSession, sf: str) -> DataFrame:
    """By id, and by label where the id is unknown."""
    d = files(spark, sf, "python")
    own = fragments.source(d).bare().nodes.where("type = 'function'").select("id", "label", "summary")
    other = table(spark, sf, "supplier").select(F.expr(f"'x::' || {K}").alias("id"), F.expr(f"'call_' || {K}").alias("label"), F.lit("other").alias("summary"))
    return types.enrich(own.unionByName(other), types.python_types(d)).select("id", "summary")


@query(f"""SELECT {PY} AS path, 'Supplier' || {K} AS name, 'Supplies parts to nation ' || CAST(s_nationkey AS STRING) || '.' AS doc FROM supplier UNION ALL SELECT {PY}, 'call_' || {K}, 'Calls supplier ' || {K} || ' now.' FROM supplier""")
def docstrings(spark: SparkSession, sf: str) -> DataFrame:
    return parse.docstrings(files(spark, sf, "python"), code.language(F.col("path")))


@query(f"SELECT {PY} || '::Supplier' || {K} AS id, 'Supplies parts to nation ' || CAST(s_nationkey AS STRING) || '.' AS summary FROM supplier")
def docstring_enriched(spark: SparkSession, sf: str) -> DataFrame:
    d = files(spark, sf, "python")
    weak = fragments.source(d).bare().nodes.where("type = 'class'").withColumn("summary", F.lit("short"))
    return parse.enrich(weak, parse.docstrings(d, code.language(F.col("path")))).select("id", "summary")


C = "CAST(c_custkey AS STRING)"
CN = "CAST(c_nationkey AS STRING)"


@query(f"""SELECT {MD} AS id, 'customer_' || {C} AS label, 'doc' AS type, 'Buys in the ' || c_mktsegment || ' segment of nation ' || {CN} || ' and pays well.' AS summary FROM customer
UNION ALL SELECT {MD} || '::' || h, h, 'concept', 'Section: ' || h FROM (SELECT *, unnest(['Customer ' || {C}, 'Orders', 'Recent', 'Contact']) AS h FROM customer) UNION ALL SELECT 'lang:python', 'python', 'external', 'Programming language: python'""")
def markdown_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return fragments.markdown(files(spark, sf, "markdown")).bare().nodes.select("id", "label", "type", "summary")


@query(f"""WITH m AS (SELECT {MD} AS path, {C} AS k, {CN} AS n FROM customer) SELECT path AS src, path || '::Customer ' || k AS dst, 'contains' AS relation FROM m UNION ALL SELECT path || '::Customer ' || k, path || '::' || unnest(['Orders', 'Contact']), 'contains' FROM m
UNION ALL SELECT path || '::Orders', path || '::Recent', 'contains' FROM m UNION ALL SELECT path, 'lang:python', 'uses' FROM m UNION ALL SELECT path, 'docs/nation_' || n || '.md', 'references' FROM m""")
def markdown_edges(spark: SparkSession, sf: str) -> DataFrame:
    return fragments.markdown(files(spark, sf, "markdown")).bare().edges


RST = path_sql("rst")


@query(f"SELECT {RST} AS src, {RST} || '::' || unnest([n_name, 'Trade']) AS dst, 'contains' AS relation FROM nation")
def rst_sections(spark: SparkSession, sf: str) -> DataFrame:
    return fragments.rst(files(spark, sf, "rst")).bare().edges


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))


FIRST = """l AS (SELECT doc_id, i, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
f AS (SELECT doc_id, i, line FROM l WHERE line = '' OR NOT regexp_matches(line, '^[#=]')), s AS (SELECT doc_id, min(i) AS a FROM f WHERE line <> '' GROUP BY doc_id),
e AS (SELECT s.doc_id, a, min(i) AS b FROM s LEFT JOIN f ON f.doc_id = s.doc_id AND f.i > a AND line = '' GROUP BY s.doc_id, a),
r AS (SELECT f.doc_id, i, line, sum(length(line) + 1) OVER (PARTITION BY f.doc_id ORDER BY i) - length(line) - 2 AS before FROM f JOIN e ON f.doc_id = e.doc_id AND i >= a AND (b IS NULL OR i < b)),
p AS (SELECT doc_id, substr(string_agg(line, ' ' ORDER BY i), 1, 200) AS paragraph FROM r WHERE before <= 150 GROUP BY doc_id)"""


@query(f"WITH {FIRST} SELECT doc_id, COALESCE(paragraph, '') AS paragraph FROM documents LEFT JOIN p USING (doc_id)")
def first_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.first_paragraph(F.col("text")).alias("paragraph"))


@query("SELECT 'd/' || doc_id || '.txt' AS id FROM documents WHERE length(trim(text)) >= 100")
def plain_documents(spark: SparkSession, sf: str) -> DataFrame:
    return fragments.plain(_texts(spark, sf)).nodes.select("id")


@query("SELECT 'doc::d/' || doc_id || '.txt' AS id, doc_id || '.txt' AS label, 'Document file: ' || doc_id || '.txt' AS summary FROM documents")
def stub_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return fragments.stub(_texts(spark, sf)).nodes.select("id", "label", "summary")


R = "CAST(r_regionkey AS STRING)"
_root = lambda name: f"'regions/region_' || {R} || '/{name}'"


@query(f"""SELECT {_root('openapi.json')} AS id, 'Region ' || r_name AS label, 'REST API v' || {R} AS summary FROM region UNION ALL SELECT {_root('openapi.json::GET:/nations')}, 'GET /nations', 'Nations of ' || r_name FROM region
UNION ALL SELECT {_root('openapi.json::schema:Nation')} || {R}, 'Nation' || {R}, 'Schema with fields: id*, name' FROM region
UNION ALL SELECT {_root('schema.prisma')}, 'prisma.schema', 'Prisma ORM database schema — models and relations' FROM region UNION ALL SELECT {_root('schema.prisma::model:Region')} || {R}, 'Region' || {R}, 'DB table: id:Int, name:String?, nations:Nation' || {R} || '[]' FROM region
UNION ALL SELECT {_root('schema.prisma::model:Nation')} || {R}, 'Nation' || {R}, 'DB table: id:Int' FROM region UNION ALL SELECT {_root('schema.prisma::enum:Kind')}, 'Kind', 'Enum: OLD, NEW' FROM region
UNION ALL SELECT {_root('schema.graphql')}, 'schema', 'GraphQL schema definition' FROM region UNION ALL SELECT {_root('schema.graphql::type:Region')} || {R}, 'Region' || {R}, 'GraphQL type: id:ID!, name:String' FROM region
UNION ALL SELECT {_root('schema.graphql::Query:region')} || {R}, 'Query.region' || {R}, 'GraphQL query → Region' || {R} FROM region UNION ALL SELECT {_root('schema.graphql::enum:Kind')}, 'Kind', 'GraphQL enum: OLD, NEW' FROM region
UNION ALL SELECT {_root('trade.proto')}, 'trade', 'Protobuf schema (package: trade)' FROM region UNION ALL SELECT {_root('trade.proto::service:Trade')} || {R}, 'Trade' || {R}, 'gRPC service — RPCs: Ship(Order)→Receipt' FROM region
UNION ALL SELECT {_root('trade.proto::rpc:Trade')} || {R} || ':Ship', 'Trade' || {R} || '.Ship', 'RPC: (Order) → Receipt' FROM region UNION ALL SELECT {_root('trade.proto::msg:Order')}, 'Order', 'Protobuf message: id:int64' FROM region""")
def schema_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _schemas(spark, sf).nodes.select("id", "label", "summary")


def _schemas(spark: SparkSession, sf: str) -> fragments.Fragments:
    d = lambda n: files(spark, sf, n)
    return (fragments.openapi(d("openapi")) + fragments.prisma(d("prisma")) + fragments.graphql(d("graphql")) + fragments.protobuf(d("proto"))).bare()


@query(f"""SELECT {_root('openapi.json')} AS src, unnest([{_root('openapi.json::GET:/nations')}, {_root('openapi.json::schema:Nation')} || {R}]) AS dst, 'defines' AS relation FROM region
UNION ALL SELECT {_root('openapi.json::GET:/nations')}, {_root('openapi.json::schema:Nation')} || {R}, 'returns' FROM region
UNION ALL SELECT {_root('schema.prisma')}, unnest([{_root('schema.prisma::model:Region')} || {R}, {_root('schema.prisma::model:Nation')} || {R}, {_root('schema.prisma::enum:Kind')}]), 'defines' FROM region
UNION ALL SELECT {_root('schema.prisma::model:Region')} || {R}, {_root('schema.prisma::model:Nation')} || {R}, 'references' FROM region
UNION ALL SELECT {_root('schema.graphql')}, unnest([{_root('schema.graphql::type:Region')} || {R}, {_root('schema.graphql::Query:region')} || {R}, {_root('schema.graphql::enum:Kind')}]), 'defines' FROM region
UNION ALL SELECT {_root('trade.proto')}, unnest([{_root('trade.proto::service:Trade')} || {R}, {_root('trade.proto::msg:Order')}]), 'defines' FROM region UNION ALL SELECT {_root('trade.proto::service:Trade')} || {R}, {_root('trade.proto::rpc:Trade')} || {R} || ':Ship', 'defines' FROM region
UNION ALL SELECT {_root('trade.proto::rpc:Trade')} || {R} || ':Ship', {_root('trade.proto::msg:Order')}, 'accepts' FROM region UNION ALL SELECT {_root('trade.proto::rpc:Trade')} || {R} || ':Ship', {_root('trade.proto::msg:Receipt')}, 'returns' FROM region""")
def schema_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _schemas(spark, sf).edges


def _configs(spark: SparkSession, sf: str) -> fragments.Fragments:
    d = lambda n: files(spark, sf, n)
    return (fragments.package_json(d("package")) + fragments.compose(d("compose")) + fragments.dotenv(d("env")) + fragments.dockerfile(d("dockerfile")) + fragments.pyproject(d("pyproject"))).bare()


NN, NR = "CAST(n_nationkey AS STRING)", "CAST(n_regionkey AS STRING)"
PKG = path_sql("package")


@query(f"""SELECT {PKG} AS id, 'nation_' || {NN} AS label, 'npm package nation_' || {NN} || '@1.' || {NN} || '.0' AS summary FROM nation UNION ALL SELECT {PKG} || '::script:build', 'build', 'npm script: make ' || {NN} FROM nation
UNION ALL SELECT DISTINCT 'pkg:region_' || {NR}, 'region_' || {NR}, 'npm region_' || {NR} || '@^1.' || {NR} FROM nation UNION ALL SELECT 'pkg:jest', 'jest', 'npm jest@~29'
UNION ALL SELECT {_root('docker-compose.yml')}, 'docker-compose.yml', 'Docker Compose: 2 services' FROM region UNION ALL SELECT {_root('docker-compose.yml::svc:web')}, 'web', 'Docker service: web (web:' || {R} || ')' FROM region
UNION ALL SELECT {_root('docker-compose.yml::svc:db')}, 'db', 'Docker service: db (store)' FROM region
UNION ALL SELECT {_root('.env')}, '.env', 'Environment config: 2 variables' FROM region UNION ALL SELECT {_root('.env::')} || v, v, 'Env variable: ' || v FROM (SELECT *, unnest(['REGION_KEY', 'DB_URL']) AS v FROM region)
UNION ALL SELECT {_root('Dockerfile')}, 'Dockerfile', 'Docker image from base:' || {R} || ', ports: 80' || {R} FROM region UNION ALL SELECT 'docker:base:' || {R}, 'base:' || {R}, 'Base Docker image: base:' || {R} FROM region
UNION ALL SELECT {_root('pyproject.toml')}, 'region_' || {R}, 'Python package region_' || {R} || '@0.' || {R} FROM region UNION ALL SELECT 'pkg:flask', 'flask', 'Python package flask' UNION ALL SELECT 'pkg:lib_' || {R}, 'lib_' || {R}, 'Python package lib_' || {R} FROM region""")
def config_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _configs(spark, sf).nodes.select("id", "label", "summary")


@query(f"""SELECT {PKG} AS src, 'pkg:region_' || {NR} AS dst, 'depends_on' AS relation FROM nation UNION ALL SELECT {PKG}, 'pkg:jest', 'dev_depends_on' FROM nation UNION ALL SELECT {PKG}, {PKG} || '::script:build', 'defines' FROM nation
UNION ALL SELECT {_root('docker-compose.yml')}, {_root('docker-compose.yml::svc:')} || unnest(['web', 'db']), 'defines' FROM region UNION ALL SELECT {_root('docker-compose.yml::svc:web')}, {_root('docker-compose.yml::svc:db')}, 'depends_on' FROM region
UNION ALL SELECT {_root('.env')}, {_root('.env::')} || unnest(['REGION_KEY', 'DB_URL']), 'defines' FROM region UNION ALL SELECT {_root('Dockerfile')}, 'docker:base:' || {R}, 'extends' FROM region
UNION ALL SELECT {_root('pyproject.toml')}, unnest(['pkg:flask', 'pkg:lib_' || {R}]), 'depends_on' FROM region""")
def config_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _configs(spark, sf).edges


@query(f"SELECT {PKG} AS id, 'JSON config with 5 top-level keys: name, version, dependencies, devDependencies, scripts' AS summary FROM nation")
def config_keys(spark: SparkSession, sf: str) -> DataFrame:
    return fragments.PARSERS["json"](files(spark, sf, "package")).nodes.select("id", "summary")


KINDS = {"python": "source", "typescript": "source", "markdown": "markdown", "rst": "rst", "package": "package_json", "compose": "compose", "openapi": "openapi", "prisma": "prisma", "graphql": "graphql", "proto": "protobuf", "env": "dotenv", "dockerfile": "dockerfile", "pyproject": "pyproject"}


@query("SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS n FROM {SAMPLES[s][0]}" for s, k in KINDS.items()) + ") GROUP BY kind")
def parser_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf, *KINDS).groupBy(fragments.kind(F.col("path")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (p_partkey % 8 <> 5) AS generated, count(*) FILTER (p_partkey % 8 = 5) AS kept FROM part")
def generated_files(spark: SparkSession, sf: str) -> DataFrame:
    g = parse.is_generated(F.col("path"), F.col("content"))
    return files(spark, sf, "generated").agg(F.count_if(g).alias("generated"), F.count_if(~g).alias("kept"))


@query(f"SELECT 'nation_' || {NN} AS diff, CASE n_nationkey % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'config' ELSE 'util' END AS layer FROM nation")
def diff_layers(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf, "diff").select(F.col("path").alias("diff"), code.layer_of_diff(F.col("content")).alias("layer"))


@query(f"SELECT 'nation_' || {NN} AS diff, 'mod_' || {NN} AS module, NULL AS symbol FROM nation UNION ALL SELECT 'nation_' || {NN}, 'lib_' || {NR}, unnest(['a', 'b']) FROM nation")
def diff_imports(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf, "diff").select(F.col("path").alias("diff"), F.inline(code.added_imports(F.col("content"))))


@query(f"SELECT 'src/' || CASE n_nationkey % 3 WHEN 0 THEN 'test_x.py' WHEN 1 THEN 'settings.py' ELSE 'x.py' END AS file, 'sell_' || {NN} AS function FROM nation")
def diff_functions(spark: SparkSession, sf: str) -> DataFrame:
    return source.changed_functions(files(spark, sf, "diff"))


@query("SELECT file, n > 5 AS full FROM (SELECT 'src/' || CASE n_nationkey % 3 WHEN 0 THEN 'test_x.py' WHEN 1 THEN 'settings.py' ELSE 'x.py' END AS file, count(*) AS n FROM nation GROUP BY 1) UNION ALL SELECT 'src/none.py', true")
def full_reextracts(spark: SparkSession, sf: str) -> DataFrame:
    found = source.changed_functions(files(spark, sf, "diff"))
    every = found.select("file").distinct().unionByName(spark.createDataFrame([("src/none.py",)], "file string"))
    return git.full_reextract(found, every)


@query("SELECT 'a' || o_custkey || '.py' AS path, CASE o_orderkey % 4 WHEN 0 THEN 'untracked' WHEN 1 THEN 'deleted' ELSE 'changed' END AS state FROM orders")
def tree_changes(spark: SparkSession, sf: str) -> DataFrame:
    code_of = "CASE o_orderkey % 4 WHEN 0 THEN '??' WHEN 1 THEN ' D' WHEN 2 THEN 'M ' ELSE 'R ' END"
    name = f"{code_of} || ' ' || if(o_orderkey % 4 = 3, 'old.py -> ', '') || 'a' || CAST(o_custkey AS STRING) || '.py'"
    return git.changed(table(spark, sf, "orders").select(F.expr(f"{name} || chr(10)").alias("content")))


@query(f"""SELECT 'python' AS kind, {PY} AS path, '# imports: os, nation_' || CAST(s_nationkey AS STRING) || ', Nation, tools' || chr(10) || substr(c, strpos(c, chr(10) || 'class')) AS body FROM (SELECT *, replace({sql(SAMPLES['python'][2])}, '    # return the amount' || chr(10), '') AS c FROM supplier)
UNION ALL SELECT 'short', {PY}, '# imports: os, nation_' || CAST(s_nationkey AS STRING) || ', Nation, tools' || chr(10) || chr(10) || 'class Supplier' || {K} || '(Nation):' || chr(10) || '    \"\"\"Supplies parts to nation ' || CAST(s_nationkey AS STRING) || '. Keyed by number.\"\"\"' || chr(10) || chr(10)
 || 'def call_' || {K} || '(amount: int, rate: float = 0.5) -> str:' || chr(10) || '    \"\"\"Calls supplier ' || {K} || ' now. More text.\"\"\"' || chr(10) FROM supplier
UNION ALL SELECT 'typescript', {TS}, '# imports: React' || chr(10) || substr(c, strpos(c, 'export interface')) FROM (SELECT *, {sql(SAMPLES['typescript'][2])} AS c FROM part)""")
def compressed_code(spark: SparkSession, sf: str) -> DataFrame:
    """Import blocks in a line (the Python form, which comes first, meets all import lines), no redundant comments; short: bodies gone too."""
    one = lambda kind, sample, aggressive: files(spark, sf, sample).select(F.lit(kind).alias("kind"), "path", text.compressed(F.col("content"), F.col("path"), aggressive).alias("body"))
    return one("python", "python", False).unionByName(one("short", "python", True)).unionByName(one("typescript", "typescript", False))


BARE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?im)^(?:#|//|<!--).*?(?:Copyright|License|SPDX).*\\n(?:(?:#|//|<!--).*\\n)*', '', 'g'), '^\\n+', ''), '(?m)[ \\t]+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '$^', '')"


@query(f"SELECT lang, CAST(sum(length(text)) AS BIGINT) AS before, CAST(sum(length({BARE})) AS BIGINT) AS after FROM documents GROUP BY lang")
def compressed_documents(spark: SparkSession, sf: str) -> DataFrame:
    lean = text.compressed(F.col("content"), F.col("path"))
    d = _texts(spark, sf).join(table(spark, sf, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "lang"), "path")
    return d.groupBy("lang").agg(F.sum(F.length("content")).alias("before"), F.sum(F.length(lean)).alias("after"))


@query(f"""SELECT {PKG} AS path, 'region_' || {NR} AS name, '1.' || {NR} AS version FROM nation UNION ALL SELECT {PKG}, 'jest', '29' FROM nation UNION ALL SELECT {_root('pyproject.toml')}, 'flask', '2' FROM region UNION ALL SELECT {_root('pyproject.toml')}, 'lib_' || {R}, '1.0' FROM region""")
def manifest_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return source.dependencies(files(spark, sf, "package", "pyproject"))


@query("SELECT 'f' || n_regionkey || '.py' AS file, 'f' || n_regionkey || '.py::' || n_name AS id, n_name AS label, CASE WHEN n_nationkey % 2 = 0 THEN 'class' ELSE 'function' END AS type FROM nation")
def lsp_symbol_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """One document with the symbols of all files, as a language server gives it."""
    n = table(spark, sf, "nation").select(F.concat(F.lit("f"), F.col("n_regionkey").cast("string"), F.lit(".py")).alias("f"), F.struct(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, 5).otherwise(12).alias("kind")).alias("s"))
    doc = n.groupBy("f").agg(F.collect_list("s").alias("s")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("f", "s")))).alias("content"))  # 25 nations
    return source.lsp_symbols(spark, doc)


@query("SELECT 'c' || o_orderkey AS commit, 'a' || o_custkey AS author, CAST(CAST(o_orderdate AS DATE) AS STRING) AS date, o_orderpriority || ' | fix' AS subject, 'part_' || l_partkey AS file FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey")
def git_log_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The commit log written out as git prints it, a text for each commit, and read back."""
    o, line = table(spark, sf, "orders"), table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    dealt = line.repartition(spread(spark, line.count()), "l_orderkey")  # by order once; a task's share doesn't grow with the lines
    names = dealt.groupBy("l_orderkey").agg(F.array_join(F.transform(F.collect_set("l_partkey"), lambda p: F.concat(F.lit("part_"), p.cast("string"))), "\n").alias("names"))
    head = F.expr("'@c' || CAST(o_orderkey AS STRING) || '|a' || CAST(o_custkey AS STRING) || '|' || CAST(CAST(o_orderdate AS DATE) AS STRING) || '|' || o_orderpriority || ' | fix' || chr(10)")
    log = names.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(head, "names", F.lit("\n\n")).alias("content"))
    return source.commit_log(log).withColumn("date", F.col("date").cast("string"))


@query("SELECT 'Is ' || n_name || ' large?' AS question FROM nation UNION ALL SELECT 'Where is ' || n_name || '?' FROM nation")
def question_files(spark: SparkSession, sf: str) -> DataFrame:
    """Question files of both forms: lists of texts, lists of objects."""
    n = table(spark, sf, "nation")
    plain = n.select(F.to_json(F.array(F.concat(F.lit("Is "), "n_name", F.lit(" large?")))).alias("content"))
    objects = n.select(F.to_json(F.array(F.struct(F.concat(F.lit("Where is "), "n_name", F.lit("?")).alias("question"), F.lit(1).alias("k")))).alias("content"))
    return source.questions(plain.unionByName(objects))


# ---- rules, imports, importance, packages


@query(f"""WITH r AS (SELECT * FROM (VALUES {", ".join(f"('{r.replace(chr(39), chr(39) * 2)}')" for r in guard.RULES["util"])}) t(rule)) SELECT {PY} AS path, rule, 'default' AS source FROM supplier, r UNION ALL SELECT {PY}, 'be kind ' || {NN}, 'learned' FROM supplier, nation WHERE n_nationkey % 3 = 2""")
def layer_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules for source files by layer: those given, and those learned from diffs of that layer."""
    d = files(spark, sf, "python").select("path", code.layer(F.col("path"), code.imports(F.col("content"), F.lit("python"))).alias("layer"))
    learned = files(spark, sf, "diff").select(code.layer_of_diff(F.col("content")).alias("layer"), F.regexp_replace("path", "nation_", "be kind ").alias("description"))
    return guard.applicable_rules(d, learned).select("path", "rule", "source")


@query("SELECT CAST(s_suppkey AS BIGINT) AS k, s_suppkey % 4 IN (0, 3) AS valid, CASE s_suppkey % 4 WHEN 1 THEN 'warning' WHEN 2 THEN 'error' ELSE 'info' END AS severity FROM supplier")
def import_validity(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols wanted of nation modules: their own, one that is missing, of a module that is missing, and none."""
    s = table(spark, sf, "supplier")
    known = s.select(F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string")).alias("module"), F.col("s_name").alias("symbol"))
    k = F.col("s_suppkey") % 4
    wanted = s.select(F.when(k == 2, F.concat(F.lit("gone_"), F.col("s_suppkey").cast("string"))).otherwise(F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string"))).alias("module"), F.when(k == 1, F.concat(F.lit("no_"), "s_name")).when(k != 3, F.col("s_name")).alias("symbol"), "s_suppkey")
    return _validity(wanted, known)


def _validity(wanted: DataFrame, known: DataFrame) -> DataFrame:
    found = guard.validity(wanted.select("module", "symbol").distinct(), known)
    same = wanted["module"].eqNullSafe(found["module"]) & wanted["symbol"].eqNullSafe(found["symbol"])
    return wanted.join(found, same).select(F.col("s_suppkey").cast("long").alias("k"), "valid", "severity")


@query("SELECT 'nation_' || s_nationkey AS module, 'no_' || s_name AS symbol, s_name AS name FROM supplier WHERE s_suppkey % 2 = 1")
def import_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """For names that are wanted with a prefix too many, the closest one that the module has."""
    s = table(spark, sf, "supplier").select(F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string")).alias("module"), "s_name", "s_suppkey")
    wanted = s.where("s_suppkey % 2 = 1").select("module", F.concat(F.lit("no_"), "s_name").alias("symbol"))
    return guard.suggestions(wanted, s.select("module", F.col("s_name").alias("symbol"))).where("rank = 1").select("module", "symbol", "name")


IMPORTANCE_SAMPLES = {"python": 0.0, "openapi": 0.10, "prisma": 0.25, "graphql": 0.25, "env": 0.0, "dockerfile": 0.0, "compose": 0.0}


@query("SELECT path, round(greatest(0.0, least(1.0, named + greatest(0.0, 0.15 - 0.015 * len(string_split(path, '/'))) + CASE WHEN n BETWEEN 2000 AND 50000 THEN 0.1 WHEN n < 200 THEN -0.05 ELSE 0.0 END)), 4) AS score FROM (" + " UNION ALL ".join(f"SELECT {path_sql(s)} AS path, length({sql(SAMPLES[s][2])}) AS n, CAST({v} AS DOUBLE) AS named FROM {SAMPLES[s][0]}" for s, v in IMPORTANCE_SAMPLES.items()) + ")")
def file_importance(spark: SparkSession, sf: str) -> DataFrame:
    return importance.scores(files(spark, sf, *IMPORTANCE_SAMPLES).select("path", F.length("content").alias("length")))


@query(f"SELECT 'scm_' || CAST(s_nationkey AS STRING) AS src, 'nation_' || CAST(s_nationkey AS STRING) AS dst, 'imports_from' AS relation FROM supplier GROUP BY s_nationkey")
def package_imports(spark: SparkSession, sf: str) -> DataFrame:
    """Python packages of suppliers that import packages named like the nations' manifests."""
    own = files(spark, sf, "python").withColumn("package", F.concat(F.lit("scm_"), F.regexp_extract("path", r"scm/n(\d+)/", 1)))
    other = files(spark, sf, "package").withColumn("package", F.element_at(F.split("path", "/"), -2))
    return packages.cross_edges(own.unionByName(other))


@query("SELECT count(*) AS packages, count(*) * 2 AS nodes, count(*) * 3 AS edges FROM nation")
def package_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes and edges of each package's own files, in all: a module and a script with three edges for each nation."""
    nodes, edges, cross = build_packages(files(spark, sf, "package"), {"package_json": fragments.package_json})
    return packages.totals(nodes, edges, cross)


@query("SELECT n_name AS repo, CASE n_nationkey % 6 WHEN 0 THEN 'pnpm' WHEN 1 THEN 'lerna' WHEN 2 THEN 'npm-workspaces' WHEN 3 THEN 'python' WHEN 4 THEN 'generic' END AS tool FROM nation")
def package_layouts(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    shape = lambda i, *rows: n.where(f"n_nationkey % 6 = {i}").select(F.col("n_name").alias("repo"), F.inline(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(c).alias("content")) for p, c in rows])))
    own = [
        shape(0, ("pnpm-workspace.yaml", ""), ("lerna.json", "{}"), ("packages/a/package.json", "{}")),
        shape(1, ("lerna.json", "{}"), ("package.json", '{"workspaces": ["x"]}')),
        shape(2, ("package.json", '{"workspaces": ["packages/*"]}')),
        shape(3, ("a/pyproject.toml", ""), ("b/setup.py", ""), ("packages/a/x.py", "")),
        shape(4, ("packages/a/x.py", ""), ("apps/b/y.py", ""), ("a/setup.py", "")),
        shape(5, ("src/a.py", ""), ("package.json", "{}")),
    ]
    out = own[0]
    for o in own[1:]:
        out = out.unionByName(o)
    return packages.layout(out)


_MEMBERS = {
    0: ["('packages/a', '@x/a' || k, 'javascript')", "('packages/b', 'b', 'unknown')", "('tools', 'tools' || k, 'javascript')"],
    1: ["('packages/a', 'p' || k, 'python')", "('packages/c', 'c', 'unknown')"],
    2: ["('libs/u', 'u', 'unknown')", "('apps/web', 'web' || k, 'mixed')", "('deep/x/core', 'core' || k, 'javascript')"],
    3: ["('mods/r', 'r' || k, 'unknown')"],
    4: ["('a', 'py' || k, 'python')", "('b', 'set' || k, 'python')"],
    5: ["('libs/q', 'q', 'unknown')", "('apps/w', 'w' || k, 'javascript')"],
}
_LAYOUTS = ("pnpm", "lerna", "npm-workspaces", "rush", "python", "nx")


@query(" UNION ALL ".join(f"SELECT repo, '{_LAYOUTS[i]}' AS tool, u.m[1] AS root, u.m[2] AS package, u.m[3] AS lang FROM (SELECT n_name AS repo, CAST(n_nationkey AS STRING) AS k FROM nation WHERE n_nationkey % 6 = {i}) n, LATERAL (SELECT unnest([" + ", ".join("[" + m[1:-1] + "]" for m in rows) + "]) AS m) u" for i, rows in _MEMBERS.items()))
def package_members(spark: SparkSession, sf: str) -> DataFrame:
    """Packages of six layouts, whose manifests are written in two ways: order, quotes, comments and nesting follow from the key."""
    n = table(spark, sf, "nation").withColumn("k", F.col("n_nationkey").cast("string"))
    odd = F.col("n_nationkey") % 4 >= 2

    def shape(i: int, *rows: tuple) -> DataFrame:
        made = [F.struct(F.lit(r[0]).alias("path"), F.replace(F.when(odd, F.lit(r[-1])).otherwise(F.lit(r[1])), F.lit("<k>"), F.col("k")).alias("content")) for r in rows]
        return n.where(f"n_nationkey % 6 = {i}").select(F.col("n_name").alias("repo"), F.inline(F.array(*made)))

    own = [
        shape(0, ("pnpm-workspace.yaml", "packages:\n  - 'packages/*'\n  - tools\n  - '!packages/old'\n", '# all\npackages:\n- "!packages/old"\n- "tools"   # here\n- packages/**\n'), ("packages/a/package.json", '{"name": "@x/a<k>"}', '{"version": "1", "name": "@x/a<k>"}'), ("packages/b/x.ts", ""), ("packages/old/package.json", "{}"), ("packages/.cache/x", ""), ("tools/package.json", '{"name":"tools<k>"}'), ("tools/sub/x.ts", "")),
        shape(1, ("lerna.json", "{}", '{"packages": ["packages/*"]}'), ("packages/a/pyproject.toml", '[project]\nname = "p<k>"\n', "[tool.poetry]\nversion = '1'\nname='p<k>'\n"), ("packages/c/deep/x.ts", ""), ("packages/.hid/x.ts", "")),
        shape(2, ("package.json", '{"workspaces": ["libs/*", "apps/web", "deep/*/core"]}', '{"workspaces": {"packages": ["deep/*/core", "./apps/web/", "libs/**"]}}'), ("libs/u/x.js", ""), ("apps/web/package.json", '{"name": "web<k>"}'), ("apps/web/pyproject.toml", ""), ("apps/web/sub/x.js", ""), ("apps/other/package.json", "{}"), ("deep/x/core/package.json", '{"name": "core<k>"}'), ("deep/x/more/package.json", "{}")),
        shape(3, ("rush.json", '{"projects": [{"packageName": "r<k>", "projectFolder": "mods/r"}, {"packageName": "gone", "projectFolder": "mods/gone"}]}', '{ // projects\n"projects": [{"projectFolder": "mods/r/", "packageName": "r<k>"}] // end\n}'), ("mods/r/x.ts", ""), ("packages/a/x.ts", ""), ("packages/b/x.ts", "")),
        shape(4, ("a/pyproject.toml", 'name = "py<k>"'), ("b/setup.py", "setup(name='set<k>')", 'from x import setup\nsetup(\n  name = "set<k>")'), ("lerna.json", '{"packages": ["none/*"]}', '{"packages": []}'), ("packages/a/x.py", "")),
        shape(5, ("nx.json", "{}", "not json"), ("libs/q/x.ts", ""), ("apps/w/package.json", '{"name": "w<k>"}'), ("apps/.h/x.ts", ""), ("lib/z/x.ts", "")),
    ]
    return packages.members(reduce(DataFrame.unionByName, own))
