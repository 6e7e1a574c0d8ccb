"""Symbols of source files, and chunks along them.

Python goes through its own parser; other languages through a scanner that blanks strings and comments, finds
declarations by their keywords, and ends each at its matching brace or ``end``. That differs from a full grammar in broken
code and in rare declaration forms. A file without symbols, or that can't be parsed, is chunked by length.
"""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.languages import LANGUAGES
from .chunking import by_length

# The kinds of symbols by language, each with a pattern for its declaration; group 1 is the name.
_CLASS = r"(?:(?:public|private|protected|internal|abstract|final|sealed|static|partial|export|default)\s+)*"
_METHOD = r"(?:(?:public|private|protected|internal|static|final|abstract|virtual|override|async|synchronized|unsafe|readonly)\s+)*"
_NOT_CALL = r"(?!(?:if|for|while|switch|catch|return|else|new|do|using|lock|foreach|throw|await|typeof|sizeof)\b)"
KINDS = {
    "javascript": {"class_declaration": _CLASS + r"class\s+(\w+)", "function_declaration": r"(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s+(\w+)", "method_definition": r"(?:(?:static|async|get|set)\s+)*" + _NOT_CALL + r"(\w+)\s*\([^;{}]*\)\s*(?=\{)", "arrow_function": r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:\([^;{}]*\)|\w+)\s*=>"},
    "typescript": {"class_declaration": _CLASS + r"class\s+(\w+)", "interface_declaration": r"(?:export\s+)?interface\s+(\w+)", "function_declaration": r"(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s+(\w+)", "type_alias_declaration": r"(?:export\s+)?type\s+(\w+)[^=;{}]*=", "enum_declaration": r"(?:export\s+)?(?:const\s+)?enum\s+(\w+)", "method_definition": r"(?:(?:public|private|protected|static|async|get|set|readonly|override)\s+)*" + _NOT_CALL + r"(\w+)\s*(?:<[^>{}]*>)?\([^;{}]*\)\s*(?::\s*[^={};]+)?(?=\{)"},
    "go": {"function_declaration": r"func\s+(\w+)\s*(?:\[[^\]]*\])?\(", "method_declaration": r"func\s+\([^)]*\)\s*(\w+)\s*\(", "type_declaration": r"type\s+(\w+)"},
    "rust": {"function_item": r"(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern(?:\s+\"\w*\")?)\s+)*fn\s+(\w+)", "impl_item": r"impl\b(?:\s*<[^>{}]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(\w+)", "struct_item": r"(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)", "trait_item": r"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(\w+)", "enum_item": r"(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"},
    "c_sharp": {"class_declaration": _CLASS + r"class\s+(\w+)", "interface_declaration": _CLASS + r"interface\s+(\w+)", "struct_declaration": _CLASS + r"(?:readonly\s+)?struct\s+(\w+)", "enum_declaration": _CLASS + r"enum\s+(\w+)", "method_declaration": _METHOD + _NOT_CALL + r"[\w<>\[\],.?]+\s+" + _NOT_CALL + r"(\w+)\s*(?:<[^>{}]*>)?\([^;{}]*\)\s*(?:where[^{;]*)?(?=\{|=>)"},
    "cpp": {"class_specifier": r"class\s+(\w+)(?=[^;(){}]*\{)", "struct_specifier": r"struct\s+(\w+)(?=[^;(){}]*\{)", "namespace_definition": r"namespace\s+(\w+)", "function_definition": r"(?:(?!(?:public|private|protected)\s*:)[\w:*&<>,~]+\s+)*[*&]*" + _NOT_CALL + r"([\w:~]+)\s*\([^;{}]*\)\s*(?:const|noexcept|override|final|\s)*(?::[^;{}]*)?(?=\{)"},
    "c": {"struct_specifier": r"struct\s+(\w+)(?=\s*\{)", "function_definition": r"(?:[\w*]+\s+)+[*]*" + _NOT_CALL + r"(\w+)\s*\([^;{}]*\)\s*(?=\{)"},
    "java": {"class_declaration": _CLASS + r"class\s+(\w+)", "interface_declaration": _CLASS + r"interface\s+(\w+)", "method_declaration": _METHOD + r"(?:<[^>{}]*>\s*)?" + _NOT_CALL + r"[\w<>\[\],.?]+\s+" + _NOT_CALL + r"(\w+)\s*\([^;{}]*\)\s*(?:throws[^{;]*)?(?=\{|;)"},
    "ruby": {"class": r"class\s+(\w+)", "module": r"module\s+(\w+)", "method": r"def\s+(?:self\.)?(\w+[?!=]?)"},
    "php": {"class_declaration": _CLASS + r"class\s+(\w+)", "method_declaration": r"(?:(?:public|private|protected|static|final|abstract)\s+)+function\s+&?(\w+)", "function_definition": r"function\s+&?(\w+)"},
}
KINDS["tsx"] = KINDS["typescript"]


def language_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    stem, dot, ext = name.rpartition(".")
    return LANGUAGES.get(ext.lower(), "text") if dot and stem.strip(".") else "text"


def _python(code: str) -> list[tuple[str, str, str, int, int, int, int]] | None:
    """(name, full name, kind, first and last line, first and last character) of classes and functions; None if it can't be parsed."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return None
    raw = code.split("\n")
    starts = [0]
    for line in raw:
        starts.append(starts[-1] + len(line) + 1)
    place = lambda line, byte: starts[line - 1] + len(raw[line - 1].encode()[:byte].decode(errors="ignore"))
    out, todo = [], [(tree, "")]
    while todo:
        node, parent = todo.pop()
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            full = f"{parent}.{node.name}" if parent else node.name
            kind = "class_definition" if isinstance(node, ast.ClassDef) else "function_definition"
            out.append((node.name, full, kind, node.lineno, node.end_lineno, place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset)))
            parent = full
        todo += [(c, parent) for c in reversed(list(ast.iter_child_nodes(node)))]
    return out


_STRINGS = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)
_HASHES = re.compile(r"""#[^\n]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""")
_RUBY_OPEN = re.compile(r"^\s*(?:class|module|def|if|unless|while|until|case|begin|for)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$")


def _blanked(code: str, lang: str) -> str:
    """Strings and comments as spaces, so that places stay; a lone apostrophe, as of a Rust lifetime, is no string."""
    pattern = _HASHES if lang == "ruby" else _STRINGS
    keep = lambda m: m[0] if lang == "rust" and m[0][0] == "'" and len(m[0]) > 4 else re.sub(r"[^\n]", " ", m[0])
    return pattern.sub(keep, code)


def _end_brace(text: str, at: int) -> int:
    """The end of a declaration that starts before ``at``: its matching brace, or a semicolon or blank line before any."""
    depth, i, n = 0, at, len(text)
    while i < n:
        c = text[i]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return i + (depth == 0)
        elif depth == 0 and (c == ";" or c == "\n" and text[i + 1 : i + 2] in ("\n", "")):
            return i + (c == ";")
        i += 1
    return n


def _end_ruby(text: str, at: int) -> int:
    """The ``end`` that closes the declaration in whose first line ``at`` is."""
    depth, i = 0, text.rfind("\n", 0, at) + 1
    while i < len(text):
        stop = text.find("\n", i)
        stop = len(text) if stop < 0 else stop
        line = text[i:stop]
        if _RUBY_OPEN.search(line) and not re.search(r"\bend\b\s*$", line):
            depth += 1
        elif re.match(r"\s*end\b", line):
            depth -= 1
        if depth <= 0:
            return i + len(line.rstrip())
        i = stop + 1
    return len(text)


def _scanned(code: str, lang: str) -> list[tuple[str, str, str, int, int, int, int]]:
    text = _blanked(code, lang)
    at: dict[int, tuple[str, str, int]] = {}
    for kind, pattern in KINDS[lang].items():
        for m in re.finditer(rf"(?m)^[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*({pattern})", text):
            start = m.start(1)
            name = next(g for g in m.groups()[1:] if g)
            # of declarations that start at one place the longer name is the more specific kind
            if start not in at:
                at[start] = (kind, name, m.end(1))
    out: list[tuple[str, str, str, int, int, int, int]] = []
    open_: list[tuple[int, str]] = []
    for start in sorted(at):
        kind, name, stop = at[start]
        end = _end_ruby(text, start) if lang == "ruby" else _end_brace(text, stop)
        while open_ and open_[-1][0] <= start:
            open_.pop()
        full = f"{open_[-1][1]}.{name}" if open_ else name
        out.append((name, full, kind, code.count("\n", 0, start) + 1, code.count("\n", 0, max(start, end - 1)) + 1, start, end))
        open_.append((end, full))
    return out


def extract(code: str, path: str, most: int = 1500) -> tuple[list[dict], list[dict]]:
    """Symbols and chunks of a file.

    A symbol: name, full_symbol, kind, start_line, end_line, signature (its first line, to 120 characters), language. Each
    is a chunk too, split by length where it is long; nested ones are in their parent's chunk as well as in their own.
    """
    lang, base = language_of(path), path.rsplit("/", 1)[-1]
    plain = lambda kind: [{"symbol": None, "kind": kind, "heading": base, "content": c, "start_line": a, "end_line": z} for c, a, z in by_length(code, most)]
    found = _python(code) if lang == "python" else _scanned(code, lang) if lang in KINDS else None
    if found is None:
        return [], plain("code")
    lines = code.splitlines()
    symbols, chunks = [], []
    for name, full, kind, first, last, start, end in found:
        line = lines[first - 1].strip() if first <= len(lines) else ""
        symbols.append({"name": name, "full_symbol": full, "kind": kind, "start_line": first, "end_line": last, "signature": line[:120], "language": lang})
        for content, a, z in by_length(code[start:end], most):
            whole = len(code[start:end]) <= most
            chunks.append({"symbol": full, "kind": kind, "heading": f"{full} ({kind})", "content": content, "start_line": first if whole else first + a - 1, "end_line": last if whole else first + z - 1})
    return symbols, chunks or plain("module")


_SYMBOL = "name string, full_symbol string, kind string, start_line int, end_line int, signature string, language string"
_CHUNK = "symbol string, kind string, heading string, content string, start_line int, end_line int"


def extracted(files: DataFrame, path: str = "filepath", content: str = "content", most: int = 1500) -> DataFrame:
    """``files`` with symbols and chunks, arrays of structs; one pass, a row at a time, without a shuffle."""

    def both(batches):
        kinds = [pa.list_(pa.struct([(n, pa.int32() if t == "int" else pa.string()) for n, t in (x.split() for x in s.split(", "))])) for s in (_SYMBOL, _CHUNK)]
        for batch in batches:
            pairs = [extract(c or "", p or "", most) for p, c in zip(batch.column(path).to_pylist(), batch.column(content).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([p[i] for p in pairs], kinds[i]) for i in (0, 1))], names=[*batch.schema.names, "symbols", "chunks"])

    schema = StructType([*files.schema.fields])
    for name, inner in (("symbols", _SYMBOL), ("chunks", _CHUNK)):
        schema = schema.add(name, ArrayType(StructType.fromDDL(inner)))
    return files.mapInArrow(both, schema)


def symbol_rows(files: DataFrame) -> DataFrame:
    """(repo, filepath, a symbol's fields) of files with symbols."""
    return files.select("repo", "filepath", F.inline("symbols"))
