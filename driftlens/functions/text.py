"""Scalar functions over columns: names, paths, comments, urls and hashes, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: FNV-1a, 64 bits.
FNV_OFFSET, FNV_PRIME, WORD = "14695981039346656037", "1099511628211", "18446744073709551616"


def squeeze(s: Column) -> Column:
    """White space at the ends gone, runs inside one space."""
    return F.regexp_replace(F.regexp_replace(s, r"^\s+|\s+$", ""), r"\s+", " ")


def bare_name(s: Column) -> Column:
    """What follows the last dot or colon."""
    return F.regexp_extract(s, r"[^.:]*$", 0)


def module_of(path: Column) -> Column:
    """A path without its extension, dotted; a package's own file names the package."""
    stem = F.regexp_replace(path, r"\.[^./]*$", "")
    return F.regexp_replace(F.regexp_replace(stem, r"(^|/)(__init__|index|mod)$", ""), "/", ".")


def first_sentence(s: Column) -> Column:
    """Up to the first full stop that white space or the end follows."""
    return F.regexp_extract(s, r"(?s)^(.*?[.])(\s|$)", 1)


def fnv1a(s: Column) -> Column:
    """64-bit FNV-1a of a string's UTF-8 bytes, as a decimal without sign: products exceed 64 bits and are reduced stepwise."""
    high = "decimal(38,0)"
    low = lambda x: F.pmod(x, F.lit("256").cast(high))

    def fold(h: Column, byte: Column) -> Column:
        mixed = h - low(h) + low(h).cast("int").bitwiseXOR(byte).cast(high)
        # h * prime mod 2**64 with prime = 2**40 + 435: the first summand keeps h's lowest 24 bits.
        shifted = F.pmod(mixed, F.lit("16777216").cast(high)) * F.lit("1099511627776").cast(high)
        return F.pmod(shifted.cast(high) + (mixed * F.lit(435).cast(high)).cast(high), F.lit(WORD).cast(high)).cast(high)

    hexed = F.hex(F.encode(s, "UTF-8"))
    places = F.when(F.length(hexed) > 0, F.sequence(F.lit(1), F.length(hexed), F.lit(2))).otherwise(F.array().cast("array<int>"))
    codes = F.transform(places, lambda i: F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("int"))
    return F.aggregate(codes, F.lit(FNV_OFFSET).cast(high), fold)


#: What is documentation by its name, folder or extension, build languages, and folders of configuration.
DOC_NAMES = ("readme", "changelog", "changes", "license", "licence", "contributing", "authors", "notice", "history", "security", "code_of_conduct")
DOC_DIRS, DOC_EXTENSIONS = ("doc", "docs", "documentation"), ("adoc", "rst", "md", "markdown")
PROSE, DATA, BUILD = ("markdown", "rst"), ("json", "yaml", "toml", "ini", "nix", "jsonnet"), ("make", "cmake")
CHORE_DIRS = (".github", ".gitlab", ".circleci", ".husky", ".devcontainer")


def path_kind(path: Column) -> Column:
    """docs, test, chore or code: by the language of the name, then by folders; what has no language is no code."""
    spec = language(path, F.lit(""))
    name = F.regexp_extract(path, r"[^/]*$", 0)
    stem, extension = F.lower(F.substring_index(name, ".", 1)), F.regexp_extract(name, r"\.([^.]*)$", 1)
    inside = lambda dirs: F.arrays_overlap(F.split(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), "/"), F.array(*[F.lit(d) for d in dirs]))
    none = spec.isNull()
    return (
        F.when(F.coalesce(spec.isin(*PROSE), F.lit(False)) | none & stem.isin(*DOC_NAMES), "docs")
        .when(is_test(path), "test")
        .when(none & (inside(DOC_DIRS) | extension.isin(*DOC_EXTENSIONS)), "docs")
        .when(none | spec.isin(*DATA, *BUILD) | inside(CHORE_DIRS) | is_generated(path), "chore")
        .otherwise("code")
    )


def is_test(path: Column) -> Column:
    return path.rlike(r"(^|/)tests?/") | path.rlike(r"(^|/)test_[^/]*$") | path.rlike(r"[_.](test|spec)\.[^/]*$")


#: Names, parts of names, ends and folders of what tools write.
LOCKFILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "go.sum", "poetry.lock", "Gemfile.lock", "composer.lock", "flake.lock", "uv.lock")
WRITTEN_ENDS = ("_generated.go", ".min.js", ".min.css", ".map", ".pb.go", "_pb2.py", ".snap")
WRITTEN_DIRS = ("/generated/", "/vendor/", "/node_modules/")


def is_generated(path: Column) -> Column:
    """Lock files, minified and generated names, vendored folders."""
    name = F.regexp_extract(path, r"[^/]*$", 0)
    found = name.isin(*LOCKFILES) | name.startswith("_generated.") | name.contains(".generated.")
    for end in WRITTEN_ENDS:
        found = found | name.endswith(end)
    for folder in WRITTEN_DIRS:
        found = found | path.contains(folder)
    return found


def glob(pattern: str) -> str:
    """A glob as a regular expression: * crosses folders, ? is one character, {a,b} alternatives, \\ escapes."""
    out, depth, k = "", 0, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "*":
            while pattern[k + 1 : k + 2] == "*":
                k += 1
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            if c == "\\":
                k += 1
                c = pattern[k : k + 1]
            out += c if c.isalnum() or c in "_/" else "\\" + c if c else ""
        k += 1
    return f"^{out}$"


def selected(path: Column, globs: list[str]) -> Column:
    """Any including glob (all, without one) and no excluding one (with ! before it), in whatever order."""
    ins = [glob(g) for g in globs if not g.startswith("!")]
    outs = [glob(g[1:]) for g in globs if g.startswith("!")]
    yes = F.lit(not ins)
    for g in ins:
        yes = yes | path.rlike(g)
    for g in outs:
        yes = yes & ~path.rlike(g)
    return yes


QUOTED = "(?s)^([\"'`])(.*)\\1$"


def unquote(s: Column) -> Column:
    """Without the pairs of equal quotes around it, however many."""
    marks = F.sequence(F.lit(0), F.length(F.regexp_extract(s, "^[\"'`]*", 0)))
    return F.aggregate(marks, s, lambda t, _: F.regexp_replace(t, QUOTED, "$2"))


def quoted(s: Column) -> Column:
    """In double quotes; in single ones when only that keeps it clear."""
    return F.when(s.contains('"') & ~s.contains("'"), F.concat(F.lit("'"), s, F.lit("'"))).otherwise(F.concat(F.lit('"'), s, F.lit('"')))


def constant_name(s: Column) -> Column:
    """SCREAMING_CASE of two characters or more with an upper-case letter, or k and an upper-case letter; no null or boolean."""
    last = bare_name(s)
    return ((F.length(last) >= 2) & last.rlike("[A-Z]") & ~last.rlike("[a-z]") | last.rlike("^k[A-Z]")) & ~last.isin("NULL", "TRUE", "FALSE", "NIL")


def round4(x: Column) -> Column:
    """Four decimals, halves away from zero."""
    return F.round(x, 4)


def url_fields(query: Column) -> Column:
    """The fields of a url's query, decoded."""
    return F.transform_values(F.str_to_map(query, F.lit("&"), F.lit("=")), lambda _, v: F.url_decode(F.regexp_replace(v, r"\+", " ")))


def comment_line(line: Column, extension: Column) -> Column:
    """Whether a line is a comment by its file's extension."""
    hash_ = extension.isin("py", "rb", "sh", "toml", "yaml", "yml")
    dash = extension.isin("lua", "sql", "hs")
    bare = F.ltrim(line)
    return F.when(hash_, bare.startswith("#")).when(dash, bare.startswith("--")).otherwise(bare.startswith("//") | bare.startswith("/*") | bare.startswith("*"))


#: Languages by extension, case-sensitive.
EXTENSIONS = {
    "py": "python", "xsh": "xonsh", "js": "javascript", "mjs": "javascript", "jsx": "javascript", "rs": "rust", "ts": "typescript", "tsx": "tsx", "go": "go", "c": "c", "h": "c",
    "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "C": "cpp", "java": "java", "lua": "lua", "md": "markdown", "rst": "rst", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml",
    "ini": "ini", "cfg": "ini", "cmake": "cmake", "mk": "make", "nix": "nix", "jsonnet": "jsonnet", "sh": "bash", "css": "css", "scss": "scss", "html": "html", "svelte": "svelte",
}
FILENAMES = {"Makefile": "make", "CMakeLists.txt": "cmake", "Cargo.lock": "toml"}
#: Interpreters of shebang lines.
INTERPRETERS = {"python": "python", "xonsh": "xonsh", "node": "javascript", "bash": "bash", "sh": "bash", "zsh": "bash", "lua": "lua"}


def mapped(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def language(path: Column, text: Column) -> Column:
    """By file name, extension (.local stripped), or the interpreter of the first line."""
    name = F.regexp_replace(F.regexp_extract(path, r"[^/]*$", 0), r"\.local$", "")
    first = F.substring_index(text, "\n", 1)
    tool = F.regexp_extract(first, r"^#!\s*\S*?([A-Za-z]+)[0-9.]*\s*$", 1)
    env = F.regexp_extract(first, r"^#!\s*\S*/env\s+(?:-\S+\s+)*([A-Za-z]+)[0-9.]*", 1)
    return F.coalesce(mapped(name, FILENAMES), mapped(F.regexp_extract(name, r"\.([^.]*)$", 1), EXTENSIONS), mapped(env, INTERPRETERS), mapped(tool, INTERPRETERS))


def qualified_name(name: Column, scope: Column, separator: str = ".") -> Column:
    """A name behind its scope; no scope: the name."""
    return F.when(F.coalesce(scope, F.lit("")) == "", name).otherwise(F.concat(scope, F.lit(separator), name))


def module_parts(path: Column) -> Column:
    """The parts of a path without its extension; a package's own file names the package."""
    parts = F.split(F.regexp_replace(path, r"\.[^.]*$", ""), "/")
    return F.when(F.element_at(parts, -1) == "__init__", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def names_module(dotted_name: Column, module: Column) -> Column:
    """Whether a dotted name is a module's (an array of parts); leading parts may be left off, trailing ones not."""
    parts = F.split(dotted_name, r"\.")
    n = F.size(parts)
    return F.when(n <= F.size(module), F.slice(module, F.size(module) - n + 1, n) == parts).otherwise(False)


def dotted(module: Column) -> Column:
    """An import's path as a dotted name: leading dots and slashes, a script's extension and steps upward gone."""
    bare = F.regexp_replace(F.regexp_replace(module, r"^[./]+", ""), r"\.(js|ts|jsx|tsx|mjs|py)$", "")
    return F.translate(F.replace(bare, F.lit("../"), F.lit("")), "/", ".")


def file_stem(path: Column) -> Column:
    return F.substring_index(F.regexp_extract(path, r"[^/]*$", 0), ".", 1)


def names_file(module: Column, path: Column) -> Column:
    """Whether the last part of an import, but for script extensions, is a file's stem."""
    tail = F.filter(F.split(module, "[/.]"), lambda x: (x != "") & ~x.isin("js", "ts"))
    return F.coalesce(F.try_element_at(tail, F.lit(-1)) == file_stem(path), F.lit(False))


def module_matches(path: Column, module: Column) -> Column:
    """Whether the last part of a module, cut at dots, slashes and colons, is a file's stem."""
    want = F.coalesce(F.try_element_at(F.filter(F.split(module, "[./:]"), lambda x: x != ""), F.lit(-1)), module)
    return (want != "") & (want == file_stem(path))


def symbols_identity(symbols: Column) -> Column:
    """Name, kind and scope of each symbol whatever their order, parted by U+001F, symbols by U+001E."""
    said = lambda s: F.concat_ws("\x1f", s["name"], s["kind"], F.coalesce(s["scope"], F.lit("")))
    return F.array_join(F.transform(F.array_sort(symbols), said), "\x1e")


def names_copyright(line: Column) -> Column:
    """Whether a line is a notice, not prose that says the word."""
    return F.lower(line).rlike(r"©|spdx-filecopyrighttext|copyright\s*(\(c\)|[0-9])")


def copyright_holder(line: Column) -> Column:
    """Who a notice names, in lower case, years and marks left out; nobody: null."""
    low = F.lower(line)
    after = lambda w: F.when(low.contains(w), F.regexp_extract(low, "(?s)" + w + "(.*)$", 1))
    rest = F.coalesce(after("spdx-filecopyrighttext:"), after("copyright"), after("©"))
    return F.nullif(squeeze(F.regexp_replace(rest, r"^[0-9\s,©-]*(\(c\))?[0-9\s,-]*", "")), F.lit(""))
