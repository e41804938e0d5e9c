"""Repositories of several packages: how they are laid out, what imports what across them, totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import code
from .keep import keep

# Manifests at the root by which a layout is told, in order of precedence, and folders that hold packages.
ROOT_MANIFESTS = (("pnpm-workspace.yaml", "pnpm"), ("nx.json", "nx"), ("lerna.json", "lerna"), ("turbo.json", "turborepo"), ("rush.json", "rush"))
FOLDERS = ("packages", "apps", "libs", "services", "modules")
PYTHON_MANIFESTS = ("pyproject.toml", "setup.py")
MANIFESTS = ("package.json", *PYTHON_MANIFESTS, "go.mod", "Cargo.toml")


def layout(files: DataFrame) -> DataFrame:
    """repo, tool of each repository's files (repo, path, content): by a root manifest, npm workspaces, two folders with Python manifests,
    or two packages in well-known folders; null for a single package."""
    name, parts = F.col("path"), F.split("path", "/")
    workspaces = (name == "package.json") & F.get_json_object("content", "$.workspaces").isNotNull()
    python = F.when((F.size(parts) == 2) & parts[1].isin(*PYTHON_MANIFESTS), parts[0])
    known = F.when((F.size(parts) >= 3) & parts[0].isin(*FOLDERS), F.concat_ws("/", parts[0], F.get(parts, F.lit(1))))
    has = {tool: F.bool_or(name == manifest).alias(tool) for manifest, tool in ROOT_MANIFESTS}
    told = files.groupBy("repo").agg(*has.values(), F.bool_or(workspaces).alias("workspaces"), F.countDistinct(python).alias("python"), F.countDistinct(known).alias("known"))
    tool = F
    for _, t in ROOT_MANIFESTS:
        tool = tool.when(F.col(t), t)
    return told.select("repo", tool.when(F.col("workspaces"), "npm-workspaces").when(F.col("python") >= 2, "python").when(F.col("known") >= 2, "generic").alias("tool"))


#: Folders that hold the packages of an Nx workspace.
NX_FOLDERS = ("apps", "libs", "packages")
#: Layouts in order of precedence; the last two count from two members on.
TOOLS = ("pnpm", "nx", "lerna", "turborepo", "rush", "npm-workspaces", "python", "generic")


def _patterns(files: DataFrame) -> DataFrame:
    """repo, rank, pattern, kind (glob, children, exact), name: what the manifests at a repository's root say its packages are."""
    top = lambda name: files.where(F.col("path") == name)
    rank = lambda tool: F.lit(TOOLS.index(tool)).alias("rank")
    none = F.lit(None).cast("string").alias("name")
    listed = lambda df, tool, items, kind="glob": df.select("repo", rank(tool), F.explode(items).alias("pattern"), F.lit(kind).alias("kind"), none)
    texts = lambda c: F.from_json(c, "array<string>")
    workspaces = F.coalesce(texts(F.get_json_object("content", "$.workspaces.packages")), texts(F.get_json_object("content", "$.workspaces")))
    fixed = lambda names: F.array(*map(F.lit, names))
    entries = F.regexp_extract_all("content", F.lit(r"""(?m)^[ \t]*-[ \t]+["']?([^"'#\s][^"'#\n]*?)["']?[ \t]*(?:#.*)?$"""), F.lit(1))
    turbo = top("package.json").join(top("turbo.json").select("repo").distinct(), "repo", "left_semi")
    projects = top("rush.json").select("repo", F.explode(F.from_json(F.regexp_replace("content", "//[^\n]*", ""), "projects array<struct<packageName:string,projectFolder:string>>")["projects"]).alias("p"))
    every = [
        listed(top("pnpm-workspace.yaml"), "pnpm", entries),
        listed(top("nx.json"), "nx", fixed(NX_FOLDERS), "children"),
        listed(top("lerna.json"), "lerna", F.coalesce(texts(F.get_json_object("content", "$.packages")), fixed(["packages/*"]))),
        listed(turbo, "turborepo", workspaces),
        projects.select("repo", rank("rush"), F.col("p.projectFolder").alias("pattern"), F.lit("exact").alias("kind"), F.col("p.packageName").alias("name")).where("pattern <> ''"),
        listed(top("package.json"), "npm-workspaces", workspaces),
        files.select("repo").distinct().select("repo", rank("generic"), F.explode(fixed(FOLDERS)).alias("pattern"), F.lit("children").alias("kind"), none),
    ]
    return reduce(DataFrame.unionByName, every)


def _folders(files: DataFrame) -> DataFrame:
    """repo, folder, parent, own (its last part) and what manifests it has, of all folders above files; the root is ''."""
    steps = F.split(code.folder(F.col("path")), "/")
    above = F.when(code.folder(F.col("path")) == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))))
    every = files.select("repo", F.explode(above).alias("folder")).distinct()
    base = code.base_name(F.col("path"))
    named = lambda manifest, value: F.max(F.when(base == manifest, value))
    quoted = lambda p: F.nullif(F.regexp_extract("content", p, 1), F.lit(""))
    has = lambda manifest: F.bool_or(base == manifest)
    told = files.groupBy("repo", code.folder(F.col("path")).alias("folder")).agg(
        has("package.json").alias("npm"), has("pyproject.toml").alias("py"), has("setup.py").alias("setup"),
        F.coalesce(named("package.json", F.get_json_object("content", "$.name")), named("pyproject.toml", quoted(r"""(?m)^name\s*=\s*["']([^"']+)["']""")), named("setup.py", quoted(r"""name\s*=\s*["']([^"']+)["']"""))).alias("said"),
    )
    return every.join(told, ["repo", "folder"], "left").fillna(False, ["npm", "py", "setup"]).withColumns({"parent": code.folder(F.col("folder")), "own": code.base_name(F.col("folder"))})


def members(files: DataFrame) -> DataFrame:
    """repo, tool, root, package, lang of the packages of each repository's files (repo, path, content), by the first layout that has any.

    A pattern is cut to the folders before its trailing stars and joined with folders by key: a folder with a manifest is a package
    itself, of another all folders in it are, but hidden ones. A star inside a pattern is matched below the folders before it. Patterns
    that begin with ! take packages out again. Packages are named by their manifest, else by their folder.
    """
    folders, said = keep(_folders(files), "folders"), _patterns(files)
    said = said.withColumn("out", F.col("pattern").startswith("!")).withColumn("pattern", F.regexp_replace(F.trim("pattern"), r"^!|^(!?)\./", "$1"))
    said = said.withColumn("prefix", F.when(F.col("kind") == "exact", F.regexp_replace("pattern", "/+$", "")).otherwise(F.regexp_replace("pattern", r"[/*]+$", "")))
    inner = (F.col("kind") == "glob") & F.col("prefix").contains("*")
    plain, starred = keep(said.where(~inner), "patterns"), said.where(inner)
    here = folders.join(plain.withColumnRenamed("prefix", "folder"), ["repo", "folder"])
    is_package = F.col("npm") | F.col("py")
    own = here.where((F.col("kind") == "exact") | ((F.col("kind") == "glob") & is_package)).select("repo", "rank", "out", "folder", "name")
    open_ = here.where((F.col("kind") == "children") | ((F.col("kind") == "glob") & ~is_package)).select("repo", "rank", "out", F.col("folder").alias("parent"))
    kids = folders.where("folder <> '' and own not like '.%'").join(open_, ["repo", "parent"]).select("repo", "rank", "out", "folder", F.lit(None).cast("string").alias("name"))
    before = F.regexp_replace("prefix", r"/?[^/]*\*.*$", "")
    as_regex = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace("prefix", r"([.+?^${}()|\[\]\\])", r"\\$1"), r"\*\*", "\u0001"), r"\*", "[^/]+"), F.lit("$"))
    wild = starred.select("repo", "rank", "out", before.alias("above"), F.replace(as_regex, F.lit("\u0001"), F.lit(".+")).alias("regex"))
    steps = F.split("folder", "/")
    deep = folders.where(is_package & (F.col("folder") != "")).select("repo", "folder", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/")))).alias("above"))
    far = deep.join(wild, ["repo", "above"]).where("folder rlike regex").select("repo", "rank", "out", "folder", F.lit(None).cast("string").alias("name"))
    python = folders.where((F.col("parent") == "") & (F.col("folder") != "") & (F.col("py") | F.col("setup")) & ~F.col("own").startswith(".")).select("repo", F.lit(TOOLS.index("python")).alias("rank"), F.lit(False).alias("out"), "folder", F.lit(None).cast("string").alias("name"))
    every = own.unionByName(kids).unionByName(far).unionByName(python)
    found = keep(every.groupBy("repo", "rank", "folder").agg(F.bool_or("out").alias("out"), F.max("name").alias("name")).where("not out"), "members")
    first = found.groupBy("repo", "rank").agg(F.count("*").alias("n")).where(f"rank < {TOOLS.index('python')} or n >= 2").groupBy("repo").agg(F.min("rank").alias("rank"))
    lang = F.when(F.col("npm") & F.col("py"), "mixed").when(F.col("npm"), "javascript").when(F.col("py") | F.col("setup"), "python").otherwise("unknown")
    out = found.join(first, ["repo", "rank"]).join(folders, ["repo", "folder"])
    tool = F.get(F.array(*map(F.lit, TOOLS)), F.col("rank"))
    return out.select("repo", tool.alias("tool"), F.col("folder").alias("root"), F.coalesce("name", "said", F.nullif("own", F.lit("")), "repo").alias("package"), lang.alias("lang"))


def roots(files: DataFrame) -> DataFrame:
    """root, package (the folder's name) of each folder with a manifest, but the top one."""
    own = files.where(code.base_name(F.col("path")).isin(*MANIFESTS)).select(code.folder(F.col("path")).alias("root")).where("root <> ''").distinct()
    return own.select("root", code.base_name(F.col("root")).alias("package"))


def with_package(files: DataFrame, packages: DataFrame) -> DataFrame:
    """files with the package of the deepest root above them (inner); roots are looked up among a file's own folders, by key."""
    steps = F.split(code.folder(F.col("path")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    hit = files.select("path", F.explode(above).alias("root")).join(packages, "root").groupBy("path").agg(F.max_by("package", F.length("root")).alias("package"))
    return files.join(hit, "path")


def cross_edges(files: DataFrame) -> DataFrame:
    """src, dst, relation between packages whose files (path, content, package) import another by name: imported names join the package
    names, no pattern for each pair of packages."""
    used = files.select("package", F.explode(code.imports(F.col("content"), code.language(F.col("path")))).alias("m")).select(F.col("package").alias("src"), F.regexp_extract("m", r"^@?([\w-]+)", 1).alias("dst"))
    return used.join(files.select(F.col("package").alias("dst")).distinct(), "dst").where("src <> dst").select("src", "dst", F.lit("imports_from").alias("relation")).distinct()


def totals(nodes: DataFrame, edges: DataFrame, cross: DataFrame) -> DataFrame:
    """One row over all packages' nodes and edges (package, ...): packages, nodes, edges with those across packages."""
    n = nodes.agg(F.countDistinct("package").alias("packages"), F.count("*").alias("nodes"))
    return n.crossJoin(edges.agg(F.count("*").alias("e"))).crossJoin(cross.agg(F.count("*").alias("c"))).select("packages", "nodes", (F.col("e") + F.col("c")).alias("edges"))
