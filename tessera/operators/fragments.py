"""Graph fragments of file contents (path, content): nodes and edges of source code, documents, schemas and configuration.

Every parser gives a Fragments of two frames, without collecting anything: regular expressions and JSON functions of the JVM. `parse`
sends each file to its parsers by name; `graph.merge_fragments` makes one graph of what they give. A row's origin is the file that it
was found in, also where its node belongs to none, so that a file's rows can be replaced when it changes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import code, text
from .keep import keep

NODE = ("id", "label", "type", "file", "lang", "summary")
EDGE = ("src", "dst", "relation")
_STRINGS = "map<string,string>"


@dataclass
class Fragments:
    nodes: DataFrame
    edges: DataFrame

    def bare(self) -> Fragments:
        """Without origins; a node that several files give and none owns is one row."""
        shared = F.col("file").isNull()
        nodes = self.nodes.where(~shared).select(*NODE).unionByName(self.nodes.where(shared).select(*NODE).distinct())
        return Fragments(nodes, self.edges.select(*EDGE))

    def __add__(self, other: Fragments) -> Fragments:
        return Fragments(self.nodes.unionByName(other.nodes), self.edges.unionByName(other.edges))


def _col(x: Column | str | None) -> Column:
    return F.lit(x).cast("string") if x is None or isinstance(x, str) else x.cast("string")


def _nodes(df: DataFrame, id: Column, label: Column | str, type: Column | str, summary: Column | str, file: Column | str | None = None, lang: Column | str | None = None) -> DataFrame:
    values = (id, label, type, F.col("path") if file is None else None if file is NOWHERE else file, lang, summary)
    return df.select(*(_col(v).alias(n) for n, v in zip(NODE, values, strict=True)), F.col("path").alias("origin"))


def _edges(df: DataFrame, src: Column, dst: Column, relation: Column | str) -> DataFrame:
    return df.select(*(_col(v).alias(n) for n, v in zip(EDGE, (src, dst, relation), strict=True)), F.col("path").alias("origin"))


#: The file of a node that no file owns, such as a package.
NOWHERE = ""


def _join(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _all(content: Column, pattern: str, *groups: int) -> Column:
    """array<struct<g1, g2, ...>> of a pattern's groups."""
    return F.arrays_zip(*(F.regexp_extract_all(content, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _listed(items: Column, most: int) -> Column:
    return F.array_join(F.slice(items, 1, most), ", ")


def _path() -> Column:
    return F.col("path")


def _name() -> Column:
    return code.base_name(_path())


def _stem() -> Column:
    return code.stem(_path())


def _content() -> Column:
    return F.col("content")


# ---- source code


def source(files: DataFrame) -> Fragments:
    """Module, class, interface and function nodes; defines, extends and imports edges; external stubs for packages.

    The first kind that has a name in a file gives its node. Relative imports lead to the joined path.
    """
    df = files.select("path", code.language(_path()).alias("lang"), "content")
    df = keep(df.select("path", "lang", code.definitions(_content(), F.col("lang")).alias("d"), code.imports(_content(), F.col("lang")).alias("m")))  # every pattern runs once
    found = df.select("path", "lang", F.posexplode("d").alias("pos", "d")).select("path", "lang", "pos", "d.*")
    one = found.groupBy("path", "lang", "name").agg(F.min_by("kind", "pos").alias("kind"))
    used = df.select("path", "lang", F.explode("m").alias("module")).withColumn("target", code.import_target(F.col("module"), _path()))
    stubs = used.where("module not like '.%' and module not like '/%'").select("path", "target").distinct()
    own = _join(_path(), "::", F.col("name"))
    what = F.when(F.col("kind") == "interface", "interface/type").otherwise(F.col("kind"))
    package = F.regexp_replace("target", "^pkg:", "")
    nodes = _union(
        _nodes(df, _path(), _stem(), "module", _join(F.col("lang"), " module: ", _stem()), lang=F.col("lang")),
        _nodes(one, own, F.col("name"), F.col("kind"), _join(F.col("lang"), " ", what, " in ", _stem()), lang=F.col("lang")),
        _nodes(stubs, F.col("target"), package, "external", _join("External package: ", package), NOWHERE),
    )
    edges = _union(
        _edges(one, _path(), own, "defines"),
        _edges(found.where("base <> ''").select("path", "name", "base").distinct(), own, F.col("base"), "extends"),
        _edges(used.select("path", "target").distinct(), _path(), F.col("target"), "imports"),
    )
    return Fragments(nodes, edges)


# ---- documents


def _doc(files: DataFrame, summary: Column, label: Column | None = None) -> DataFrame:
    return _nodes(files, _path(), _stem() if label is None else label, "doc", summary)


def _sections(heads: DataFrame, parent: Column | None = None) -> Fragments:
    """Concept nodes of (path, title), below a parent."""
    own = _join(_path(), "::", F.col("title"))
    return Fragments(_nodes(heads, own, F.col("title"), "concept", _join("Section: ", F.col("title"))), _edges(heads, _path() if parent is None else parent, own, "contains"))


# Fences that show no programming language, and how many headings and links of a document count.
NO_LANGUAGE = ("bash", "sh", "shell", "console", "text", "plain")
MOST_HEADINGS, MOST_RST, MOST_PDF, MOST_DOCX, MOST_LINKS = 20, 15, 15, 12, 10


def markdown(files: DataFrame) -> Fragments:
    """First paragraph, heading tree (each below the last one of a lower level), languages of fenced code, links to other documents."""
    heads = files.select("path", F.slice(text.headings(_content()), 1, MOST_HEADINGS).alias("h")).select("path", "h", F.posexplode("h").alias("i", "own"))
    above = F.filter(F.slice("h", 1, F.col("i")), lambda x: x["level"] < F.col("own.level"))
    heads = heads.select("path", F.col("own.title").alias("title"), F.try_element_at(above, F.lit(-1))["title"].alias("above"))
    tree = _sections(heads, F.when(F.col("above").isNull(), _path()).otherwise(_join(_path(), "::", F.col("above"))))
    fences = F.array_distinct(F.regexp_extract_all(_content(), F.lit(r"(?m)^```(\w+)"), F.lit(1)))
    langs = files.select("path", F.explode(fences).alias("l")).where(~F.col("l").isin(*NO_LANGUAGE))
    links = F.slice(F.regexp_extract_all(_content(), F.lit(r"\[[^\]]+\]\(([^)]+\.md[^)]*)\)"), F.lit(1)), 1, MOST_LINKS)
    linked = files.select("path", F.explode(links).alias("to")).withColumn("to", code.joined(_path(), F.substring_index("to", "#", 1)))
    nodes = _union(_doc(files, F.coalesce(F.nullif(text.first_paragraph(_content()), F.lit("")), _join("Markdown: ", _name()))), tree.nodes, _nodes(langs, _join("lang:", F.col("l")), F.col("l"), "external", _join("Programming language: ", F.col("l")), NOWHERE))
    edges = _union(tree.edges, _edges(langs, _path(), _join("lang:", F.col("l")), "uses"), _edges(linked, _path(), F.col("to"), "references"))
    return Fragments(nodes, edges)


def rst(files: DataFrame) -> Fragments:
    heads = F.slice(F.regexp_extract_all(_content(), F.lit(r"""(?m)^(.+)\n[=\-~`#"^*+]{3,}\s*$"""), F.lit(1)), 1, MOST_RST)
    tree = _sections(files.select("path", F.explode(heads).alias("title")).withColumn("title", _strip(F.col("title"))))
    return Fragments(_doc(files, F.coalesce(F.nullif(text.first_paragraph(_content()), F.lit("")), _join("RST document: ", _name()))).unionByName(tree.nodes), tree.edges)


def plain(files: DataFrame) -> Fragments:
    """Texts of 100 characters and more."""
    long = files.where(F.length(F.trim(_content())) >= 100)
    head = F.replace(F.substring(_content(), 1, 120), F.lit("\n"), F.lit(" "))
    return Fragments(_doc(long, F.coalesce(F.nullif(text.first_paragraph(_content()), F.lit("")), head), _name()), _edges(long.limit(0), _path(), _path(), ""))


def pdf(files: DataFrame) -> Fragments:
    """Of extracted text (`sources.files.document_text`): upper-case or numbered section lines. Texts under 50 characters give nothing."""
    fine = files.where(F.length(F.trim(_content())) >= 50)
    heads = F.slice(F.regexp_extract_all(_content(), F.lit(r"(?m)^(?:\d+\.?\s+)?([A-Z][A-Z\s\-]{4,60})$"), F.lit(1)), 1, MOST_PDF)
    tree = _sections(fine.select("path", F.explode(heads).alias("title")).withColumn("title", _strip(F.col("title"))).where("length(title) >= 5"))
    return Fragments(_doc(fine, F.coalesce(F.nullif(text.first_paragraph(_content()), F.lit("")), F.lit("PDF document"))).unionByName(tree.nodes), tree.edges)


def docx(files: DataFrame) -> Fragments:
    """Of extracted text whose heading lines begin with #: a chain of headings, each below the one before."""
    lines = F.filter(F.transform(F.split(_content(), "\n"), _strip), lambda x: x != "")
    heads = F.slice(F.transform(F.filter(lines, lambda x: x.startswith("# ")), lambda x: F.substring(x, 3, 100_000)), 1, MOST_DOCX)
    first = F.get(F.filter(lines, lambda x: ~x.startswith("# ")), F.lit(0))
    each = files.select("path", heads.alias("h")).select("path", "h", F.posexplode("h").alias("i", "title")).withColumn("above", F.when(F.col("i") > 0, F.get("h", F.col("i") - 1)))
    tree = _sections(each, F.when(F.col("above").isNull(), _path()).otherwise(_join(_path(), "::", F.col("above"))))
    return Fragments(_doc(files, F.coalesce(F.substring(first, 1, 150), _join("Word document: ", _name()))).unionByName(tree.nodes), tree.edges)


def stub(files: DataFrame) -> Fragments:
    """What takes the place of a model's extraction where there is none: one node for each file."""
    return Fragments(_nodes(files, _join("doc::", _path()), _name(), "doc", _join("Document file: ", _name())), _edges(files.limit(0), _path(), _path(), ""))


def split_batch(nodes: DataFrame, edges: DataFrame, batch: DataFrame) -> DataFrame:
    """path, id of a batch's nodes (batch, id, file): under their file if the batch (batch, path) has it, else under its first path."""
    first = batch.groupBy("batch").agg(F.min("path").alias("first"))
    own = batch.select("batch", "path").distinct()
    return nodes.join(own, (nodes["batch"] == own["batch"]) & (nodes["file"] == own["path"]), "left").select(nodes["batch"], "id", "path").join(first, "batch").select("batch", F.coalesce("path", "first").alias("path"), "id")


# ---- schemas


_REF = r'"\$ref"\s*:\s*"[^"]*?([^"/]+)"'


def openapi(files: DataFrame) -> Fragments:
    """Endpoints with what they accept and return, and component schemas with their fields (* if required); JSON documents."""
    media = "map<string,struct<schema:string>>"
    d = files.withColumn("d", F.from_json("content", "info struct<title:string,description:string,version:string>, paths map<string,map<string,string>>, components struct<schemas:map<string,string>>, openapi string, swagger string")).where("d.openapi is not null or d.swagger is not null")
    operation = f"summary string, description string, requestBody struct<content:{media}>, responses map<string,struct<content:{media}>>"
    ops = d.select("path", F.explode("d.paths").alias("url", "ops")).select("path", "url", F.explode("ops").alias("method", "op")).where(F.lower("method").isin("get", "post", "put", "delete", "patch", "head", "options"))
    ops = ops.select("path", F.concat(F.upper("method"), F.lit(":"), "url").alias("key"), F.concat_ws(" ", F.upper("method"), "url").alias("title"), F.from_json("op", operation).alias("op")).where("op is not null")
    end = _join(_path(), "::", F.col("key"))
    refs = lambda content: F.filter(F.transform(F.map_values(content), lambda m: F.regexp_extract(m["schema"], _REF, 1)), lambda r: r != "")
    accepts = ops.where("op.requestBody.content is not null").select("path", "key", F.explode(F.array_distinct(refs(F.col("op.requestBody.content")))).alias("ref"))
    answers = ops.select("path", "key", F.explode("op.responses").alias("status", "r")).where("r.content is not null").select("path", "key", F.explode(F.array_distinct(refs(F.col("r.content")))).alias("ref")).distinct()
    models = d.select("path", F.explode("d.components.schemas").alias("name", "s")).select("path", "name", F.from_json("s", f"properties {_STRINGS}, required array<string>").alias("s")).where("s is not null")
    required = F.coalesce("s.required", F.array().cast("array<string>"))
    fields = F.transform(F.coalesce(F.map_keys("s.properties"), F.array().cast("array<string>")), lambda p: F.concat(p, F.when(F.array_contains(required, p), "*").otherwise("")))
    model = _join(_path(), "::schema:", F.col("name"))
    about = F.substring("d.info.description", 1, 120)
    nodes = _union(
        _nodes(d, _path(), F.coalesce("d.info.title", _stem()), "module", F.concat(F.lit("REST API v"), F.coalesce("d.info.version", F.lit("")), F.when(about != "", F.concat(F.lit(": "), about)).otherwise(""))),
        _nodes(ops, end, F.col("title"), "function", F.substring(F.coalesce("op.summary", "op.description", "title"), 1, 150)),
        _nodes(models, model, F.col("name"), "class", F.when(F.size(fields) > 0, _join("Schema with fields: ", _listed(fields, 8))).otherwise("Data schema")),
    )
    to = _join(_path(), "::schema:", F.col("ref"))
    return Fragments(nodes, _union(_edges(ops, _path(), end, "defines"), _edges(models, _path(), model, "defines"), _edges(accepts, end, to, "accepts"), _edges(answers, end, to, "returns")))


# Field types of database schemas that refer to no model.
SCALARS = ("String", "Int", "BigInt", "Float", "Decimal", "Boolean", "DateTime", "Json", "Bytes")


def _blocks(files: DataFrame, pattern: str) -> DataFrame:
    """path, name, body of the blocks a pattern finds (its first two groups)."""
    return files.select("path", F.explode(_all(_content(), pattern, 1, 2)).alias("z")).select("path", F.col("z.g1").alias("name"), F.col("z.g2").alias("body"))


def prisma(files: DataFrame) -> Fragments:
    """Models with fields and references to other models, and enums."""
    models = _blocks(files, r"model\s+(\w+)\s*\{([^}]+)\}").withColumn("f", _all(F.col("body"), r"(?m)^\s+(\w+)\s+(\w+)(\[\])?(\?)?", 1, 2, 3, 4))
    shown = F.transform("f", lambda x: F.concat(x["g1"], F.lit(":"), x["g2"], x["g3"], x["g4"]))
    more = F.when(F.size("f") > 6, F.format_string(" +%d more", F.size("f") - 6)).otherwise("")
    refs = models.select("path", "name", F.explode(F.array_distinct(F.transform("f", lambda x: x["g2"]))).alias("to")).where(F.col("to").rlike("^[A-Z]") & ~F.col("to").isin(*SCALARS))
    enums = _blocks(files, r"enum\s+(\w+)\s*\{([^}]+)\}").withColumn("v", F.regexp_extract_all("body", F.lit(r"(?m)^\s+(\w+)\s*$"), F.lit(1)))
    own, kind = _join(_path(), "::model:", F.col("name")), _join(_path(), "::enum:", F.col("name"))
    nodes = _union(
        _nodes(files, _path(), "prisma.schema", "config", "Prisma ORM database schema — models and relations"),
        _nodes(models, own, F.col("name"), "class", _join("DB table: ", _listed(shown, 6), more)),
        _nodes(enums, kind, F.col("name"), "concept", _join("Enum: ", _listed(F.col("v"), 8))),
    )
    return Fragments(nodes, _union(_edges(models, _path(), own, "defines"), _edges(refs, own, _join(_path(), "::model:", F.col("to")), "references"), _edges(enums, _path(), kind, "defines")))


def graphql(files: DataFrame) -> Fragments:
    """Types, the fields of Query, Mutation and Subscription as functions (at most 20 each), and enums."""
    bare = files.withColumn("content", F.regexp_replace(F.regexp_replace(_content(), r'(?s)""".*?"""', ""), r"#[^\n]*", ""))
    kinds = bare.select("path", F.explode(_all(_content(), r"(type|interface|input)\s+(\w+)(?:\s+implements[^{]*)?\s*\{([^}]+)\}", 1, 2, 3)).alias("z")).select("path", F.col("z.g1").alias("kind"), F.col("z.g2").alias("name"), _all(F.col("z.g3"), r"(?m)^\s+(\w+)[^:]*?(?:\([^)]*\))?\s*:\s*(\[?\w+\]?[!?]*)", 1, 2).alias("f"))
    is_root = F.col("name").isin("Query", "Mutation", "Subscription")
    types, roots = kinds.where(~is_root), kinds.where(is_root).select("path", "name", F.explode(F.slice("f", 1, 20)).alias("f"))
    enums = _blocks(bare, r"enum\s+(\w+)\s*\{([^}]+)\}").withColumn("v", F.regexp_extract_all("body", F.lit(r"(?m)^\s+(\w+)"), F.lit(1)))
    own, call, kind = _join(_path(), "::type:", F.col("name")), _join(_path(), "::", F.col("name"), ":", F.col("f.g1")), _join(_path(), "::enum:", F.col("name"))
    shown = F.transform("f", lambda x: F.concat(x["g1"], F.lit(":"), x["g2"]))
    nodes = _union(
        _nodes(files, _path(), _stem(), "module", "GraphQL schema definition"),
        _nodes(types, own, F.col("name"), F.when(F.col("kind") == "type", "class").otherwise("concept"), _join("GraphQL ", F.col("kind"), ": ", _listed(shown, 6))),
        _nodes(roots, call, _join(F.col("name"), ".", F.col("f.g1")), "function", _join("GraphQL ", F.lower("name"), " → ", F.col("f.g2"))),
        _nodes(enums, kind, F.col("name"), "concept", _join("GraphQL enum: ", _listed(F.col("v"), 8))),
    )
    return Fragments(nodes, _union(_edges(types, _path(), own, "defines"), _edges(roots, _path(), call, "defines"), _edges(enums, _path(), kind, "defines")))


def protobuf(files: DataFrame) -> Fragments:
    """Services, their calls with what they accept and return, and messages."""
    bare = files.withColumn("content", F.regexp_replace(F.regexp_replace(_content(), r"//[^\n]*", ""), r"(?s)/\*.*?\*/", ""))
    package = F.regexp_extract(_content(), r"package\s+([\w.]+)", 1)
    services = _blocks(bare, r"service\s+(\w+)\s*\{([^}]+)\}").withColumn("r", _all(F.col("body"), r"rpc\s+(\w+)\s*\((\w+)\)\s*returns\s*\((\w+)\)", 1, 2, 3))
    calls = services.select("path", "name", F.explode("r").alias("r"))
    messages = _blocks(bare, r"message\s+(\w+)\s*\{([^}]+)\}").withColumn("f", _all(F.col("body"), r"(?:optional|required|repeated)?\s*(\w+)\s+(\w+)\s*=\s*\d+", 1, 2))
    own, call, message = _join(_path(), "::service:", F.col("name")), _join(_path(), "::rpc:", F.col("name"), ":", F.col("r.g1")), _join(_path(), "::msg:", F.col("name"))
    shown = _listed(F.transform("r", lambda x: F.concat(x["g1"], F.lit("("), x["g2"], F.lit(")→"), x["g3"])), 5)
    fields = _listed(F.transform("f", lambda x: F.concat(x["g2"], F.lit(":"), x["g1"])), 6)
    nodes = _union(
        _nodes(bare, _path(), _stem(), "module", F.concat(F.lit("Protobuf schema"), F.when(package != "", _join(" (package: ", package, ")")).otherwise(""))),
        _nodes(services, own, F.col("name"), "class", _join("gRPC service — RPCs: ", F.when(shown != "", shown).otherwise("none"))),
        _nodes(calls, call, _join(F.col("name"), ".", F.col("r.g1")), "function", _join("RPC: (", F.col("r.g2"), ") → ", F.col("r.g3"))),
        _nodes(messages, message, F.col("name"), "class", _join("Protobuf message: ", F.when(fields != "", fields).otherwise("no fields"))),
    )
    to = lambda g: _join(_path(), "::msg:", F.col(f"r.{g}"))
    return Fragments(nodes, _union(_edges(services, _path(), own, "defines"), _edges(calls, own, call, "defines"), _edges(calls, call, to("g2"), "accepts"), _edges(calls, call, to("g3"), "returns"), _edges(messages, _path(), message, "defines")))


def json_schema(files: DataFrame) -> Fragments:
    """The schema as a class and its properties as concepts."""
    d = files.withColumn("d", F.from_json("content", f"title string, description string, properties {_STRINGS}")).where("d is not null")
    fields = d.select("path", F.explode("d.properties").alias("name", "p")).select("path", "name", F.from_json("p", "type string, description string").alias("p"))
    own = _join(_path(), "::", F.col("name"))
    text_of = lambda c, n: F.nullif(F.substring(c, 1, n), F.lit(""))
    about = F.coalesce(text_of("d.description", 120), _join("JSON Schema with fields: ", _listed(F.coalesce(F.map_keys("d.properties"), F.array().cast("array<string>")), 8)))
    nodes = _nodes(d, _path(), F.coalesce("d.title", _stem()), "class", about).unionByName(_nodes(fields, own, F.col("name"), "concept", F.coalesce(text_of("p.description", 80), _join(F.coalesce("p.type", F.lit("any")), " field"))))
    return Fragments(nodes, _edges(fields, _path(), own, "contains"))


# ---- configuration


def package_json(files: DataFrame) -> Fragments:
    d = files.withColumn("d", F.from_json("content", f"name string, version string, description string, dependencies {_STRINGS}, devDependencies {_STRINGS}, peerDependencies {_STRINGS}, scripts {_STRINGS}")).where("d is not null")
    name = F.coalesce("d.name", code.base_name(code.folder(_path())))
    kinds = {"dependencies": "depends_on", "devDependencies": "dev_depends_on", "peerDependencies": "dev_depends_on"}
    deps = _union(*(d.select("path", F.explode(f"d.{k}").alias("dep", "version")).withColumn("relation", F.lit(r)) for k, r in kinds.items()))
    scripts = d.select("path", F.explode("d.scripts").alias("name", "run"))
    own, package = _join(_path(), "::script:", F.col("name")), _join("pkg:", F.col("dep"))
    stubs = deps.groupBy("path", "dep").agg(F.min("version").alias("version"))
    nodes = _union(
        _nodes(d, _path(), name, "module", F.coalesce(F.nullif(F.col("d.description"), F.lit("")), _join("npm package ", name, "@", F.coalesce("d.version", F.lit("?"))))),
        _nodes(stubs, package, F.col("dep"), "external", _join("npm ", F.col("dep"), "@", F.col("version")), NOWHERE),
        _nodes(scripts, own, F.col("name"), "function", _join("npm script: ", F.substring("run", 1, 80))),
    )
    return Fragments(nodes, _union(_edges(deps, _path(), package, F.col("relation")), _edges(scripts, _path(), own, "defines")))


def tsconfig(files: DataFrame) -> Fragments:
    d = files.withColumn("d", F.from_json("content", "compilerOptions struct<target:string,module:string,paths:map<string,array<string>>>")).where("d is not null")
    alias = d.select("path", F.explode("d.compilerOptions.paths").alias("name", "to"))
    own, known = _join(_path(), "::alias:", F.col("name")), lambda c: F.coalesce(f"d.compilerOptions.{c}", F.lit("?"))
    nodes = _nodes(d, _path(), _name(), "config", _join("TypeScript config: target=", known("target"), ", module=", known("module"))).unionByName(_nodes(alias, own, F.col("name"), "module", _join("TS path alias → ", F.coalesce(F.get("to", F.lit(0)), F.lit("?")))))
    return Fragments(nodes, _edges(alias, _path(), own, "defines"))


def generic_keys(files: DataFrame, keys: Column, most: int, summary) -> Fragments:
    """A config node that lists the file's first top-level keys."""
    d = files.withColumn("k", keys)
    return Fragments(_nodes(d, _path(), _name(), "config", summary(F.size("k"), _listed(F.col("k"), most))), _edges(d.limit(0), _path(), _path(), ""))


def _section(name: str) -> Column:
    """The indented block below a top-level key of YAML."""
    return F.regexp_extract(_content(), rf"(?ms)^{name}:[ \t]*\n(.*?)(?=^\S|\z)", 1)


_ENTRY = r"(?m)^  ([\w.-]+):[ \t]*\n((?:^(?:   +[^\n]*)?(?:\n|\z))*)"


def compose(files: DataFrame) -> Fragments:
    """Services with their images and what they depend on."""
    d = files.withColumn("s", F.filter(_all(_section("services"), _ENTRY, 1, 2), lambda x: x["g1"] != ""))
    each = d.select("path", F.explode("s").alias("s")).select("path", F.col("s.g1").alias("name"), F.col("s.g2").alias("body"))
    image = F.coalesce(F.nullif(F.regexp_extract("body", r"(?m)^\s+image:\s*(\S+)", 1), F.lit("")), F.lit("custom"))
    inline = F.regexp_extract("body", r"(?m)^\s+depends_on:\s*\[([^\]]*)\]", 1)
    listed = F.regexp_extract("body", r"(?m)^\s+depends_on:[ \t]*\n((?:\s+-?\s*[\w.-]+:?[ \t]*(?:\n|\z))+)", 1)
    needs = each.select("path", "name", F.explode(F.array_distinct(F.regexp_extract_all(F.concat_ws("\n", inline, listed), F.lit(r"([\w.-]*\w[\w.-]*)"), F.lit(1)))).alias("dep"))
    own = _join(_path(), "::svc:", F.col("name"))
    nodes = _nodes(d, _path(), _name(), "config", F.format_string("Docker Compose: %d services", F.size("s"))).unionByName(_nodes(each, own, F.col("name"), "class", _join("Docker service: ", F.col("name"), " (", image, ")")))
    return Fragments(nodes, _edges(each, _path(), own, "defines").unionByName(_edges(needs, own, _join(_path(), "::svc:", F.col("dep")), "depends_on")))


def workflow(files: DataFrame) -> Fragments:
    d = files.withColumn("s", _all(_section("jobs"), _ENTRY, 1, 2))
    each = d.select("path", F.explode("s").alias("s")).select("path", F.col("s.g1").alias("name"), F.coalesce(F.nullif(F.regexp_extract("s.g2", r"(?m)^\s+runs-on:\s*(\S+)", 1), F.lit("")), F.lit("?")).alias("on"))
    own = _join(_path(), "::job:", F.col("name"))
    nodes = _nodes(d, _path(), _stem(), "config", F.format_string("GitHub Actions: %d jobs", F.size("s"))).unionByName(_nodes(each, own, F.col("name"), "function", _join("CI job on ", F.col("on"))))
    return Fragments(nodes, _edges(each, _path(), own, "defines"))


def pyproject(files: DataFrame) -> Fragments:
    """Name, version, description and dependencies (a list, or a table of the older form); python itself is none."""
    part = F.regexp_extract(_content(), r"(?ms)^\[project\][ \t]*\n(.*?)(?=^\[|\z)", 1)
    old = F.regexp_extract(_content(), r"(?ms)^\[tool\.poetry\][ \t]*\n(.*?)(?=^\[|\z)", 1)
    table_ = F.regexp_extract(_content(), r"(?ms)^\[tool\.poetry\.dependencies\][ \t]*\n(.*?)(?=^\[|\z)", 1)
    d = files.withColumn("p", F.when(part != "", part).otherwise(old)).withColumn("t", table_)
    value = lambda k: F.nullif(F.regexp_extract("p", rf'(?m)^{k}\s*=\s*"([^"]*)"', 1), F.lit(""))
    listed = F.transform(F.regexp_extract_all(F.regexp_extract("p", r"(?ms)^dependencies\s*=\s*\[(.*?)^?\]\s*$", 1), F.lit(r"""["']([^"']+)["']"""), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, r"(?:>=|==).*$", "")))
    keyed = F.regexp_extract_all(F.col("t"), F.lit(r"(?m)^([\w.-]+)\s*="), F.lit(1))
    deps = d.select("path", F.explode(F.array_distinct(F.concat(listed, keyed))).alias("dep")).where("dep <> 'python' and dep <> ''")
    name = F.coalesce(value("name"), code.base_name(code.folder(_path())))
    nodes = _nodes(d, _path(), name, "module", F.coalesce(value("description"), _join("Python package ", name, "@", F.coalesce(value("version"), F.lit("?"))))).unionByName(_nodes(deps, _join("pkg:", F.col("dep")), F.col("dep"), "external", _join("Python package ", F.col("dep")), NOWHERE))
    return Fragments(nodes, _edges(deps, _path(), _join("pkg:", F.col("dep")), "depends_on"))


def dotenv(files: DataFrame) -> Fragments:
    """Names of variables, never their values; nodes for the first 20."""
    d = files.withColumn("k", F.regexp_extract_all(_content(), F.lit(r"(?m)^([A-Z_][A-Z0-9_]{2,})\s*="), F.lit(1)))
    keys = d.select("path", F.explode(F.slice("k", 1, 20)).alias("name"))
    own = _join(_path(), "::", F.col("name"))
    nodes = _nodes(d, _path(), _name(), "config", F.format_string("Environment config: %d variables", F.size("k"))).unionByName(_nodes(keys, own, F.col("name"), "concept", _join("Env variable: ", F.col("name"))))
    return Fragments(nodes, _edges(keys, _path(), own, "defines"))


def dockerfile(files: DataFrame) -> Fragments:
    d = files.withColumns({"i": F.regexp_extract_all(_content(), F.lit(r"(?im)^FROM\s+(\S+)"), F.lit(1)), "e": F.regexp_extract_all(_content(), F.lit(r"(?im)^EXPOSE\s+(\d+)"), F.lit(1))})
    images = d.select("path", F.explode(F.array_distinct("i")).alias("name"))
    ports = F.when(F.size("e") > 0, F.concat(F.lit(", ports: "), F.array_join("e", ","))).otherwise("")
    nodes = _nodes(d, _path(), "Dockerfile", "config", F.concat(F.lit("Docker image from "), F.coalesce(F.get("i", F.lit(0)), F.lit("?")), ports)).unionByName(_nodes(images, _join("docker:", F.col("name")), F.col("name"), "external", _join("Base Docker image: ", F.col("name")), NOWHERE))
    return Fragments(nodes, _edges(images, _path(), _join("docker:", F.col("name")), "extends"))


# ---- dispatch

# Names and suffixes by which files are told apart.
SCHEMA_NAMES = tuple(f"{a}.{b}" for a in ("openapi", "swagger", "api", "asyncapi") for b in ("yaml", "json"))
SCHEMA_SUFFIXES = (".prisma", ".graphql", ".gql", ".proto")
CONFIG_SUFFIXES = (".json", ".yaml", ".yml", ".toml", ".env")
CONFIG_NAMES = ("dockerfile", ".dockerignore", ".editorconfig", ".gitattributes", ".npmrc", ".yarnrc")
DOCUMENT_SUFFIXES = (".pdf", ".docx", ".md", ".markdown", ".mdx", ".rst", ".txt")


def is_schema(path: Column) -> Column:
    name = F.lower(code.base_name(path))
    return code.suffix(path).isin(*SCHEMA_SUFFIXES) | name.isin(*SCHEMA_NAMES) | name.rlike(r"[._-]schema\.json$")


def is_config(path: Column) -> Column:
    name = F.lower(code.base_name(path))
    return code.suffix(path).isin(*CONFIG_SUFFIXES) | name.isin(*CONFIG_NAMES) | name.startswith(".env")


def is_document(path: Column) -> Column:
    return code.suffix(path).isin(*DOCUMENT_SUFFIXES)


def is_code(path: Column) -> Column:
    return code.language(path) != "generic"


def kind(path: Column) -> Column:
    """Name of the parser that a file goes to; null where none knows it (`stub` is for those)."""
    name, s = F.lower(code.base_name(path)), code.suffix(path)
    return (
        F.when(s == ".prisma", "prisma").when(s.isin(".graphql", ".gql"), "graphql").when(s == ".proto", "protobuf")
        .when(name.isin(*SCHEMA_NAMES), "openapi").when(name.rlike(r"[._-]schema\.json$"), "json_schema")
        .when(name == "package.json", "package_json").when(name.startswith("tsconfig") & (s == ".json"), "tsconfig")
        .when(name.rlike(r"(?:docker|compose).*\.ya?ml$"), "compose").when(path.rlike(r"\.github/.*\.ya?ml$"), "workflow")
        .when(name == "pyproject.toml", "pyproject").when(name.startswith(".env"), "dotenv").when(name == "dockerfile", "dockerfile")
        .when(s == ".json", "json").when(s.isin(".yaml", ".yml"), "yaml").when(s == ".toml", "toml")
        .when(s.isin(".md", ".markdown", ".mdx"), "markdown").when(s == ".rst", "rst").when(s == ".txt", "plain").when(s == ".pdf", "pdf").when(s == ".docx", "docx")
        .when(is_code(path), "source")
    )


PARSERS = {
    "prisma": prisma, "graphql": graphql, "protobuf": protobuf, "openapi": openapi, "json_schema": json_schema, "package_json": package_json,
    "tsconfig": tsconfig, "compose": compose, "workflow": workflow, "pyproject": pyproject, "dotenv": dotenv, "dockerfile": dockerfile,
    "json": lambda f: generic_keys(f, F.json_object_keys("content"), 5, lambda n, k: F.format_string("JSON config with %d top-level keys: %s", n, k)),
    "yaml": lambda f: generic_keys(f, F.regexp_extract_all(_content(), F.lit(r"(?m)^(\w[\w-]*):"), F.lit(1)), 6, lambda n, k: _join("YAML config: ", k)),
    "toml": lambda f: generic_keys(f, F.array_distinct(F.regexp_extract_all(_content(), F.lit(r"(?m)^\[+([\w-]+)"), F.lit(1))), 5, lambda n, k: _join("TOML config: sections=", k)),
    "markdown": markdown, "rst": rst, "plain": plain, "pdf": pdf, "docx": docx, "source": source,
}


def parse(files: DataFrame, parsers: dict | None = None) -> Fragments:
    """Fragments of all files (path, content), each from the parser of its kind; files of no kind become stubs."""
    parsers = parsers or PARSERS
    df = keep(files.withColumn("kind", kind(_path())), "kinds")
    there = {r.kind for r in df.select("kind").distinct().collect()}  # at most as many as there are parsers
    parts = [f(df.where(F.col("kind") == name).drop("kind")) for name, f in parsers.items() if name in there]
    return reduce(Fragments.__add__, [*parts, stub(df.where("kind is null").drop("kind"))])
