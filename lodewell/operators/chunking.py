"""Splitting sources into chunks: Markdown sections in built-in functions, code by scanners in Arrow batches."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

ANONYMOUS, PREAMBLE = "(anonymous)", "(preamble)"
LANGUAGES = {"rs": "rust", "py": "python", "go": "go", "yaml": "yaml", "yml": "yaml", "bzl": "starlark", "md": "markdown", "markdown": "markdown"}
FILENAMES = {"BUILD": "starlark", "BUILD.bazel": "starlark", "WORKSPACE": "starlark", "WORKSPACE.bazel": "starlark"}


def language(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    return FILENAMES.get(name) or (LANGUAGES.get(name.rsplit(".", 1)[-1]) if "." in name else None)


def markdown_sections(files: DataFrame, path: str, text: str) -> DataFrame:
    """(path, ord, name, source, embed_text): a line that begins with # and has other text starts a section, in fenced code too.

    The heading is the line without its #s and outer space; what precedes the first is (preamble);
    sections of white space only go. One shuffle, by file.
    """
    body = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n", "\n"), "\n$", "")
    lines = files.select(path, F.posexplode(F.split(body, "\n")).alias("pos", "line"))
    title = F.trim(F.regexp_replace("line", "^#+", ""))
    lines = lines.withColumn("head", F.when(F.col("line").startswith("#") & (title != ""), title))
    upto = Window.partitionBy(path).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("ord", F.count("head").over(upto))
    s = lines.groupBy(path, "ord").agg(F.max("head").alias("name"), F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("a"))
    s = s.withColumn("source", F.array_join(F.transform("a", lambda x: x["line"]), "\n"))
    s = s.withColumn("embed_text", F.regexp_replace("source", r"^\s+|\s+$", "")).where("embed_text <> ''")
    return s.select(path, "ord", F.coalesce("name", F.lit(PREAMBLE)).alias("name"), "source", "embed_text")


def _markdown(text: str) -> list[tuple[str, str, str]]:
    out, name, own = [], PREAMBLE, []
    for line in [*text.replace("\r\n", "\n").removesuffix("\n").split("\n"), None]:
        title = line.lstrip("#").strip() if line is not None and line.startswith("#") else ""
        if line is None or title:
            if "".join(own).strip():
                out.append(("section", name, "\n".join(own)))
            name, own = title, []
        if line is not None:
            own.append(line)
    return out


def _span(lines: list[str], node: ast.AST) -> str:
    first, last = lines[node.lineno - 1 : node.end_lineno], node.end_col_offset
    first = [s.encode() for s in first]
    first[-1] = first[-1][:last]
    first[0] = first[0][node.col_offset :]
    return b"\n".join(first).decode()


#: Lines without indent that go on with the statement before, and those that belong to the one after.
_ON, _AHEAD = re.compile(r"[\])}]|(?:else|elif|except|finally)\b|#|$"), re.compile(r"@")


def _trees(text: str) -> list[ast.AST]:
    """The syntax trees of a file: one, or if it can't be parsed those of its top-level statements that can."""
    try:
        return [ast.parse(text)]
    except (SyntaxError, ValueError):
        pass
    lines, starts, ahead = text.split("\n"), [], False
    for i, line in enumerate(lines):
        if line[:1].isspace() or _ON.match(line):
            continue
        if not ahead:
            starts.append(i)
        ahead = bool(_AHEAD.match(line))
    out = []
    for a, b in zip(starts, [*starts[1:], len(lines)], strict=True):
        try:
            out.append(ast.increment_lineno(ast.parse("\n".join(lines[a:b])), a))
        except (SyntaxError, ValueError):
            continue
    return out


def _python(text: str, starlark: bool = False) -> list[tuple[str, str, str]]:
    lines, found = text.replace("\r\n", "\n").split("\n"), []
    for node in (n for tree in _trees("\n".join(lines)) for n in ast.walk(tree)):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            found.append((node, "function", node.name))
        elif isinstance(node, ast.ClassDef) and not starlark:
            found.append((node, "class", node.name))
        elif starlark and isinstance(node, ast.Expr) and isinstance(node.value, ast.Call) and isinstance(node.value.func, ast.Name):
            found.append((node, "expression", node.value.func.id))
    found.sort(key=lambda x: (x[0].lineno, x[0].col_offset))
    return [(kind, name, _span(lines, n)) for n, kind, name in found]


_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|`[^`]*`|'(?:\\.|[^'\\])'", re.S)


def _bare(text: str) -> str:
    """The text with comments and strings blanked, character by character."""
    return _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _end(bare: str, at: int) -> int:
    """Where an item that begins at `at` ends: its closing bracket, or the first semicolon outside of brackets."""
    depth = 0
    for i in range(at, len(bare)):
        c = bare[i]
        if c in "{([":
            depth += 1
        elif c in "})]":
            depth -= 1
            if depth == 0 and c == "}":
                return i + 1
        elif c == ";" and depth == 0:
            return i + 1
    return len(bare)


_RUST = re.compile(r"(?:^|(?<=[{};]))[ \t]*((?:pub(?:\([^)]*\))?[ \t]+)?(?:(?:async|const|unsafe|default|extern(?:[ \t]+\"[^\"]*\")?)[ \t]+)*(fn|struct|enum|trait|impl)\b[ \t]*([A-Za-z_]\w*)?)", re.M)
_RUST_KINDS = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "impl": "impl"}


def _rust(text: str) -> list[tuple[str, str, str]]:
    bare = _bare(text)
    return [(_RUST_KINDS[m[2]], ANONYMOUS if m[2] == "impl" else m[3] or ANONYMOUS, text[m.start(1) : _end(bare, m.start(1))]) for m in _RUST.finditer(bare)]


_GO = re.compile(r"^(func)[ \t]*(\([^)]*\))?[ \t]*([A-Za-z_]\w*)|^(type)[ \t]+(?:([A-Za-z_]\w*)|\()", re.M)
_GO_SPEC = re.compile(r"^[ \t]*([A-Za-z_]\w*)[ \t]+\S", re.M)


def _go(text: str) -> list[tuple[str, str, str]]:
    bare, out = _bare(text), []
    for m in _GO.finditer(bare):
        if m[1]:
            out.append(("method" if m[2] else "function", m[3], text[m.start() : _end(bare, m.start())]))
        elif m[5]:
            line = bare.find("\n", m.start())
            line = len(bare) if line < 0 else line
            out.append(("type_decl", m[5], text[m.start() : _end(bare, m.start()) if "{" in bare[m.start() : line] else line]))
        else:
            depth, i = 1, m.end()
            names, start = [], m.end()
            while i < len(bare) and depth:
                if depth == 1 and (i == start or bare[i - 1] == "\n") and (s := _GO_SPEC.match(bare, i)):
                    names.append(s[1])
                depth += (bare[i] in "({[") - (bare[i] in ")}]")
                i += 1
            out += [("type_decl", n, text[m.start() : i]) for n in names]
    return out


_PAIR = re.compile(r"^(\s*(?:- +)*)([^\s#'\"\[{:][^:#]*?|\"[^\"]*\"|'[^']*')\s*:(?:\s|$)")


def _yaml(text: str) -> list[tuple[str, str, str]]:
    lines, out = text.replace("\r\n", "\n").split("\n"), []
    for i, line in enumerate(lines):
        if not (m := _PAIR.match(line)):
            continue
        depth, j = len(m[1]), i + 1
        while j < len(lines) and (not lines[j].strip() or len(lines[j]) - len(lines[j].lstrip()) > depth or lines[j][depth:].startswith("- ") and not lines[j][:depth].strip() and "-" not in m[1]):
            j += 1
        out.append(("block_mapping", m[2], "\n".join([line[depth:], *lines[i + 1 : j]]).rstrip()))
    return out


_PARSERS = {"rust": _rust, "python": _python, "go": _go, "yaml": _yaml, "starlark": lambda t: _python(t, True), "markdown": _markdown}


def chunks(path: str, text: str) -> list[tuple[str, str, str]]:
    """(kind, name, source) of a file's chunks; none for a language that has no scanner."""
    parse = _PARSERS.get(language(path) or "")
    return parse(text) if parse else []


def chunk_files(files: DataFrame, path: str = "source_path", text: str = "text") -> DataFrame:
    """(source_path, ord, kind, name, source, embed_text) of every file's chunks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, i, *c) for p, t in zip(pdf[path], pdf[text], strict=True) for i, c in enumerate(chunks(p, t or ""))]
            yield pd.DataFrame(rows, columns=["source_path", "ord", "kind", "name", "source"])

    found = files.select(path, text).mapInPandas(run, "source_path string, ord int, kind string, name string, source string")
    trimmed = F.when(F.col("kind") == "section", F.regexp_replace("source", r"^\s+|\s+$", "")).otherwise(T.embed_text(F.col("source")))
    return found.withColumn("embed_text", trimmed)
