"""Symbols of source code by language: names that regular expressions find, as columns. All JVM-side."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language by lower-case suffix.
LANGUAGES = {
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "typescript": (".ts", ".tsx", ".mts"),
    "python": (".py", ".pyw"),
    "go": (".go",),
    "rust": (".rs",),
    "java": (".java",),
    "kotlin": (".kt", ".kts"),
    "swift": (".swift",),
    "csharp": (".cs",),
    "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".h"),
    "c": (".c",),
    "ruby": (".rb",),
    "php": (".php",),
    "vue": (".vue",),
    "svelte": (".svelte",),
    "dart": (".dart",),
    "scala": (".scala",),
    "zig": (".zig",),
    "lua": (".lua",),
    "r": (".r",),
    "bash": (".sh", ".bash"),
    "yaml": (".yaml", ".yml"),
    "json": (".json",),
    "toml": (".toml",),
    "css": (".css", ".scss", ".sass", ".less"),
    "html": (".html", ".htm"),
    "terraform": (".tf", ".hcl"),
    "sql": (".sql",),
}

# For each language and kind the patterns whose first group is the name. Languages not listed use "generic".
_JS_IMPORT = (r"""import\s+(?:[\w*{}\s,]+\s+from\s+)?['"]([^'"]+)['"]""", r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)""", r"""import\s*\(\s*['"]([^'"]+)['"]\s*\)""")
PATTERNS: dict[str, dict[str, tuple[str, ...]]] = {
    "javascript": {
        "import": _JS_IMPORT,
        "class": (r"class\s+(\w+)(?:\s+extends\s+(\w+))?",),
        "function": (r"(?:function|const|let|var)\s+(\w+)\s*(?:=\s*(?:async\s+)?(?:\([^)]*\)|[\w]+)\s*=>|\()", r"(?:async\s+)?function\s+(\w+)\s*\("),
        "interface": (r"interface\s+(\w+)", r"type\s+(\w+)\s*="),
    },
    "typescript": {
        "import": (r"""import\s+(?:type\s+)?(?:[\w*{}\s,]+\s+from\s+)?['"]([^'"]+)['"]""", r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)"""),
        "class": (r"class\s+(\w+)(?:\s+extends\s+(\w+))?(?:\s+implements\s+[\w,\s]+)?",),
        "function": (r"(?:function|const|let|var)\s+(\w+)\s*(?:<[^>]*>)?\s*(?:=\s*(?:async\s+)?\(?|:\s*\w+\s*=)", r"(?:async\s+)?function\s+(\w+)\s*(?:<[^>]*>)?\s*\("),
        "interface": (r"interface\s+(\w+)", r"type\s+(\w+)\s*(?:<[^>]*>)?\s*=", r"enum\s+(\w+)"),
    },
    "python": {"import": (r"(?m)^import\s+([\w.]+)(?:\s+as\s+\w+)?", r"(?m)^from\s+([\w.]+)\s+import"), "class": (r"(?m)^class\s+(\w+)(?:\s*\(([^)]*)\))?",), "function": (r"(?m)^(?:async\s+)?def\s+(\w+)\s*\(",), "interface": ()},
    "go": {"import": (r'import\s+"([\w./]+)"', r'import\s+\w+\s+"([\w./]+)"'), "class": (r"type\s+(\w+)\s+struct", r"type\s+(\w+)\s+interface"), "function": (r"func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)\s*\(",), "interface": (r"type\s+(\w+)\s+interface",)},
    "rust": {"import": (r"use\s+([\w:]+)(?:::\{[^}]+\}|::\*)?", r"extern\s+crate\s+(\w+)"), "class": (r"(?:pub\s+)?struct\s+(\w+)", r"(?:pub\s+)?enum\s+(\w+)"), "function": (r"(?:pub\s+)?(?:async\s+)?fn\s+(\w+)",), "interface": (r"(?:pub\s+)?trait\s+(\w+)",)},
    "java": {
        "import": (r"(?m)^import\s+([\w.]+)\s*;",),
        "class": (r"(?:public|private|protected)?\s*(?:abstract\s+)?class\s+(\w+)(?:\s+extends\s+(\w+))?", r"(?:public|private|protected)?\s*interface\s+(\w+)"),
        "function": (r"(?:public|private|protected|static|\s)+[\w<>\[\]]+\s+(\w+)\s*\([^)]*\)\s*(?:throws[^{]*)?\{",),
        "interface": (r"interface\s+(\w+)",),
    },
    "kotlin": {"import": (r"(?m)^import\s+([\w.]+)(?:\.\*)?",), "class": (r"(?:data\s+|sealed\s+|abstract\s+|open\s+)?class\s+(\w+)", r"object\s+(\w+)", r"interface\s+(\w+)"), "function": (r"(?:fun|suspend\s+fun|private\s+fun|public\s+fun)\s+(\w+)",), "interface": (r"interface\s+(\w+)",)},
    "csharp": {
        "import": (r"(?m)^using\s+([\w.]+)\s*;",),
        "class": (r"(?:public|private|internal|protected)?\s*(?:abstract\s+|static\s+|sealed\s+)?class\s+(\w+)", r"(?:public|private|internal)?\s*interface\s+(\w+)"),
        "function": (r"(?:public|private|protected|internal|static|async|\s)+\w+\s+(\w+)\s*\([^)]*\)\s*\{",),
        "interface": (r"interface\s+(\w+)",),
    },
    "swift": {"import": (r"(?m)^import\s+(\w+)",), "class": (r"(?:public\s+|open\s+|private\s+|internal\s+)?(?:class|struct|enum|actor)\s+(\w+)", r"(?:public\s+)?protocol\s+(\w+)"), "function": (r"(?:public\s+|private\s+|internal\s+|open\s+)?(?:override\s+)?func\s+(\w+)",), "interface": (r"protocol\s+(\w+)",)},
    "dart": {"import": (r"(?m)^import\s+'([^']+)'", r'(?m)^import\s+"([^"]+)"'), "class": (r"(?:abstract\s+)?class\s+(\w+)", r"mixin\s+(\w+)"), "function": (r"(?:Future<\w+>|void|String|int|bool|List|Map|\w+)\s+(\w+)\s*\([^)]*\)\s*(?:async\s*)?\{",), "interface": ()},
    "ruby": {"import": (r"""require\s+['"]([^'"]+)['"]""", r"""require_relative\s+['"]([^'"]+)['"]""", r"include\s+(\w+)"), "class": (r"class\s+(\w+)(?:\s*<\s*(\w+))?", r"module\s+(\w+)"), "function": (r"def\s+(?:self\.)?(\w+)",), "interface": (r"module\s+(\w+)",)},
    "vue": {"import": _JS_IMPORT, "class": (r"""name:\s*['"](\w+)['"]""",), "function": (), "interface": ()},
    "css": {"import": (r"""@import\s+(?:url\s*\(\s*)?['"]?([^'"\s)]+)['"]?""",), "class": (r"\.([\w-]+)\s*\{",), "function": (), "interface": ()},
    "generic": {"import": (r"""(?:import|include|require|use)\s+['"]?([^\s'"<>]+)['"]?""",), "class": (r"(?:class|interface|struct|type)\s+(\w+)",), "function": (r"(?:function|def|fn|func|method|fun)\s+(\w+)",), "interface": ()},
}
# Words that function patterns catch but that name nothing; function matches of a file that count.
NOISE = ("if", "for", "while", "return", "new", "delete", "const", "let", "var")
MOST_FUNCTIONS = 51


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language(path: Column) -> Column:
    """Language by suffix, "generic" if unknown."""
    s = suffix(path)
    return reduce(lambda c, kv: c.when(s.isin(*kv[1]), kv[0]), LANGUAGES.items(), F).otherwise("generic")


def _by_language(lang: Column, of) -> Column:
    named = [k for k in PATTERNS if k != "generic"]
    return reduce(lambda c, k: c.when(lang == k, of(PATTERNS[k])), named[1:], F.when(lang == named[0], of(PATTERNS[named[0]]))).otherwise(of(PATTERNS["generic"]))


def definitions(content: Column, lang: Column) -> Column:
    """array<struct<kind, name, base>> of each match, classes first, then interfaces, then functions: names of at most 80 characters,
    functions without noise words and only the first MOST_FUNCTIONS. base: what a class extends, empty if nothing."""

    def matches(kind: str, pattern: str) -> Column:
        get = lambda g: F.regexp_extract_all(content, F.lit(pattern), F.lit(g))
        base = get(2) if re.compile(pattern).groups > 1 and kind == "class" else None
        pairs = F.arrays_zip(get(1).alias("n"), base.alias("b")) if base is not None else F.transform(get(1), lambda n: F.struct(n.alias("n"), F.lit("").alias("b")))
        return F.transform(pairs, lambda x: F.struct(F.lit(kind).alias("kind"), x["n"].alias("name"), x["b"].alias("base")))

    def of(kinds: dict[str, tuple[str, ...]]) -> Column:
        parts = []
        for kind in ("class", "interface", "function"):
            if kinds[kind]:
                found = F.concat(*[matches(kind, p) for p in kinds[kind]])
                fine = F.filter(found, lambda x: (x["name"] != "") & (F.length(x["name"]) <= 80) & (~x["name"].isin(*NOISE) if kind == "function" else F.lit(True)))  # noqa: B023
                parts.append(F.slice(fine, 1, MOST_FUNCTIONS) if kind == "function" else fine)
        return F.concat(*parts) if parts else F.array().cast("array<struct<kind:string,name:string,base:string>>")

    return _by_language(lang, of)


def imports(content: Column, lang: Column) -> Column:
    """Distinct imports in the order of their patterns, of at most 200 characters."""
    every = _by_language(lang, lambda kinds: F.concat(*[F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in kinds["import"]]))
    return F.filter(F.array_distinct(every), lambda m: (m != "") & (F.length(m) <= 200))


def symbols(content: Column, lang: Column) -> Column:
    """array<struct<kind, name>>: distinct names of each kind, imports last."""
    own = F.array_distinct(F.transform(definitions(content, lang), lambda d: F.struct(d["kind"].alias("kind"), d["name"].alias("name"))))
    return F.concat(own, F.transform(imports(content, lang), lambda m: F.struct(F.lit("import").alias("kind"), m.alias("name"))))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def folder(path: Column) -> Column:
    """What stands before the last slash, empty if there is none."""
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), "/$", "")


def normal_path(path: Column) -> Column:
    """The path without empty and "." steps, each ".." taking the step before it."""

    def step(acc: Column, p: Column) -> Column:
        last = F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(".."))
        return F.when(p.isin("", "."), acc).when((p == "..") & (last != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))

    steps = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), steps)).otherwise(steps)


def joined(path: Column, to: Column) -> Column:
    """A path relative to a file's folder."""
    return normal_path(F.when(folder(path) == "", to).otherwise(F.concat_ws("/", folder(path), to)))


def import_target(module: Column, path: Column) -> Column:
    """Node id that an import of a file leads to: pkg:<package>, or a relative import joined to the importing file's folder."""
    return F.when(module.startswith("."), joined(path, module)).otherwise(package_of(module))


def package_of(module: Column) -> Column:
    """pkg:<name> of a non-relative import (two parts of a scoped one), the path itself of a relative one."""
    parts = F.split(module, "/")
    scoped = module.startswith("@") & (F.size(parts) >= 2)
    return F.when(module.startswith("."), module).when(scoped, F.concat(F.lit("pkg:"), parts[0], F.lit("/"), F.get(parts, F.lit(1)))).otherwise(F.concat(F.lit("pkg:"), parts[0]))


# File names and imported packages that tell a layer, in order of precedence.
CONFIG_NAMES = ("config.py", "settings.py", "constants.py", "env.py", "conf.py")
LAYER_IMPORTS = {
    "test": ("pytest", "unittest"),
    "api": ("fastapi", "flask", "starlette", "aiohttp", "django", "sanic", "tornado", "falcon", "bottle", "quart"),
    "ui": ("tkinter", "PyQt5", "PyQt6", "wx", "streamlit", "dash", "gradio", "panel", "bokeh", "kivy"),
}


def _is_test(name: Column) -> Column:
    return name.startswith("test_") | name.endswith("_test.py")


def layer(path: Column, imports: Column) -> Column:
    """Architectural layer of a Python file: by name (test, config), else by what it imports, else util."""
    top = F.transform(imports, lambda m: F.split(F.regexp_replace(m, r"^\.+", ""), r"\.")[0])
    name = base_name(path)
    out = F.when(~path.endswith(".py"), "unknown").when(_is_test(F.lower(name)), "test").when(name.isin(*CONFIG_NAMES), "config")
    return reduce(lambda c, kv: c.when(F.arrays_overlap(top, F.array(*[F.lit(x) for x in kv[1]])), kv[0]), LAYER_IMPORTS.items(), out).otherwise("util")


def layer_of_diff(diff: Column) -> Column:
    """Layer by the first file name in a diff's headers that tells one, else util."""
    heads = F.transform(F.regexp_extract_all(diff, F.lit(r"(?m)^(?:\+\+\+|---)[^\n]*?(\S+)[ \t]*$"), F.lit(1)), lambda p: F.lower(base_name(p)))
    told = F.transform(heads, lambda n: F.when(_is_test(n), "test").when(n.isin(*CONFIG_NAMES), "config"))
    return F.coalesce(F.get(F.filter(told, lambda x: x.isNotNull()), F.lit(0)), F.lit("util"))


def added_imports(diff: Column) -> Column:
    """array<struct<module, symbol>> imported on the added lines of a diff; symbol is null for whole modules and for *."""
    plain = F.transform(F.regexp_extract_all(diff, F.lit(r"(?m)^\+\s*import\s+([\w.]+)"), F.lit(1)), lambda m: F.struct(m.alias("module"), F.lit(None).cast("string").alias("symbol")))
    froms = F.regexp_extract_all(diff, F.lit(r"(?m)^\+\s*from\s+[\w.]+\s+import\s+[\w*, ]+"), F.lit(0))

    def each(line: Column) -> Column:
        module = F.regexp_extract(line, r"from\s+([\w.]+)\s+import", 1)
        names = F.split(F.regexp_replace(line, r"^\+\s*from\s+[\w.]+\s+import\s+", ""), r"\s*,\s*")
        return F.transform(names, lambda n: F.struct(module.alias("module"), F.when(F.trim(n) != "*", F.trim(F.regexp_extract(n, r"^\s*(\w+)", 1))).alias("symbol")))

    return F.array_distinct(F.concat(plain, F.flatten(F.transform(froms, each))))


# Stems that tell what a file is about, and the questions that follow.
STEMS = {
    "auth": (("auth", "login", "session", "jwt", "token", "user", "permission"), ("how does authentication work?", "what is the auth flow?", "which files handle user sessions?", "what handles login?")),
    "db": (("model", "schema", "database", "db", "migration", "entity"), ("what database models exist?", "how does the data layer work?", "what are the main data types?")),
    "api": (("api", "route", "controller", "handler", "endpoint", "view"), ("what API endpoints exist?", "how does routing work?", "what endpoints does this module expose?")),
    "infra": (("config", "setting", "env", "docker", "deploy"), ("what configuration settings exist?", "how is the application configured?")),
}


def predicted_questions(path: Column) -> Column:
    """Likely questions after a change of a file, most likely first."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.lower(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))
    about = lambda s: (F.concat(F.lit("what does "), s, F.lit(" do?")), F.concat(F.lit("who calls functions in "), s, F.lit("?")))
    none = F.array().cast("array<string>")
    out = F.array(*about(stem), F.concat(F.lit("what does "), stem, F.lit(" depend on?")))
    for words, questions in STEMS.values():
        out = F.concat(out, F.when(reduce(lambda a, b: a | b, [stem.contains(w) for w in words]), F.array(*[F.lit(q) for q in questions])).otherwise(none))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(stem, "test_|_test", ""), r"\.spec", ""), "^_+|_+$", "")
    test = (stem.startswith("test_") | stem.endswith("_test") | stem.contains("spec")) & (clean != "")
    return F.array_distinct(F.concat(F.when(test, F.array(*about(clean), F.lit("which files have test coverage?"))).otherwise(none), out))
