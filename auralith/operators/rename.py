"""Rename templates and folder plans as string expressions.

Templates have fields, variables, pipes, calls, if / else / with / range and trim marks; each is compiled once into one
Column, so rendering never leaves the plan. Named templates, break and continue are refused.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from auralith.functions.exprs import distinct_first, slug, stem

ACTION = re.compile(r"""\{\{(-\s)?((?:/\*.*?\*/|"(?:[^"\\]|\\.)*"|`[^`]*`|(?!\s-\}\}|\}\})[^"`])*)(\s-)?\}\}""", re.S)
WORD = re.compile(r"""\s*("(?:[^"\\]|\\.)*"|`[^`]*`|:=|[(),|]|[^\s(),|:"`]+)""")
VERB = re.compile(r"%([-+ 0#]*\d*(?:\.\d+)?)([a-zA-Z%])")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
FIELDS = {"Name": "file_name", "Extension": "extension", "Format": "format", "Path": "path", "RelativePath": "relative_path", "SourceRoot": "source_root"}
NUMBERS = {"ID": "id", "SizeBytes": "size_bytes"}
MISSING = "<no value>"


class TemplateError(ValueError):
    """A template that cannot be compiled."""


@dataclass(frozen=True)
class Value:
    """kind is text, number, truth, list (of texts), map (of texts), sources (of tags) or root; column is None for the
    last two, and null for a key that is not there. true, if given, says when a value of mixed kinds holds."""

    kind: str
    column: Column | None = None
    true: Column | None = None
    literal: str | None = None


ROOT = Value("root")


def _text(text: str) -> Value:
    return Value("text", F.lit(text), literal=text)


def _of_source(source: Column) -> Value:
    found = F.array_sort(F.transform(F.filter("tag_rows", lambda t: t["source"] == source), lambda t: t["name"]))
    return Value("list", F.when(F.size(found) > 0, found))


def _field(value: Value, name: str) -> Value:
    if value.kind == "root":
        if name == "Stem":
            return Value("text", stem(F.col("file_name")))
        if name == "Tags":
            return Value("list", F.array_sort("tags"))
        if name == "TagsBySource":
            return Value("sources")
        if name in ("Attributes", "Metadata"):
            return Value("map", F.col(name.lower()))
        if name in FIELDS:
            return Value("text", F.col(FIELDS[name]).cast("string"))
        if name in NUMBERS:
            return Value("number", F.col(NUMBERS[name]).cast("long"))
    elif value.kind == "map":
        return Value("text", F.try_element_at(value.column, F.lit(name)))
    elif value.kind == "sources":
        return _of_source(F.lit(name))
    raise TemplateError(f"unknown field {name}")


def _printed(value: Value) -> Column:
    if value.kind in ("root", "sources"):
        raise TemplateError("only fields can be printed")
    shown = value.column
    if value.kind == "list":
        shown = F.concat(F.lit("["), F.array_join(shown, " "), F.lit("]"))
    elif value.kind == "map":
        pairs = F.transform(F.array_sort(F.map_keys(shown)), lambda k: F.concat(k, F.lit(":"), F.try_element_at(value.column, k)))
        shown = F.concat(F.lit("map["), F.array_join(pairs, " "), F.lit("]"))
    return F.coalesce(shown.cast("string"), F.lit(MISSING))


def _holds(value: Value) -> Column:
    """Whether a value counts as true: empty texts, lists and maps, zero and what is not there do not."""
    if value.true is not None:
        return value.true
    if value.kind == "root":
        return F.lit(True)
    if value.kind == "sources":
        return F.size("tag_rows") > 0
    test = {"text": lambda c: c != "", "number": lambda c: c != 0, "truth": lambda c: c, "list": lambda c: F.size(c) > 0, "map": lambda c: F.size(c) > 0}
    return F.coalesce(test[value.kind](value.column), F.lit(False))


def _as(value: Value, kind: str, empty=None) -> Column:
    if value.kind != kind:
        raise TemplateError(f"expected a {kind}, not a {value.kind}")
    return value.column if empty is None else F.coalesce(value.column, F.lit(empty))


def _refuse(reason: str, kind: str) -> Column:
    return F.raise_error(F.lit(reason)).cast(kind)


def _index(value: Value, *keys: Value) -> Value:
    for key in keys:
        if value.kind == "sources":
            value = _of_source(_as(key, "text", ""))
        elif value.kind == "map":
            value = Value("text", F.coalesce(F.try_element_at(value.column, _as(key, "text", "")), F.lit("")))
        else:
            at = F.get(_as(value, "list"), _as(key, "number").cast("int"))
            value = Value("text", F.coalesce(at, _refuse("the template's index is out of range", "string")))
    return value


def _slice(value: Value, *ends: Value) -> Value:
    if value.kind not in ("list", "text"):
        raise TemplateError("slice takes a list or a text")
    n = F.size(value.column) if value.kind == "list" else F.length(value.column)
    start, end = ([_as(e, "number").cast("int") for e in ends] + [F.lit(0), n][len(ends) :])[:2]
    part = F.slice(value.column, start + 1, end - start) if value.kind == "list" else F.substring(value.column, start + 1, end - start)
    return Value(value.kind, F.when((start >= 0) & (start <= end) & (end <= n), part).otherwise(_refuse("the template's slice is out of range", "array<string>" if value.kind == "list" else "string")))


def _length(value: Value) -> Value:
    if value.kind == "sources":
        return Value("number", F.size(F.array_distinct(F.transform("tag_rows", lambda t: t["source"]))))
    if value.kind == "text":
        return Value("number", F.octet_length(F.coalesce(value.column, F.lit(""))))
    if value.kind not in ("list", "map"):
        raise TemplateError(f"a {value.kind} has no length")
    return Value("number", F.coalesce(F.size(value.column), F.lit(0)))


def _choice(test: Column, yes: Value, no: Value) -> Value:
    if yes.kind == no.kind and yes.column is not None and yes.true is None and no.true is None:
        return Value(yes.kind, F.when(test, yes.column).otherwise(no.column))
    return Value("text", F.when(test, _printed(yes)).otherwise(_printed(no)), F.when(test, _holds(yes)).otherwise(_holds(no)))


def _compared(name: str, first: Value, *others: Value) -> Value:
    if not others or name != "eq" and len(others) > 1:
        raise TemplateError(f"{name} takes two values")
    kind = first.kind
    if kind not in ("text", "number", "truth") or any(o.kind != kind for o in others):
        raise TemplateError(f"{name} takes values of one kind")
    empty = {"text": "", "number": 0, "truth": False}[kind]
    a, *rest = [_as(v, kind, empty) for v in (first, *others)]
    tests = {"eq": lambda b: a == b, "ne": lambda b: a != b, "lt": lambda b: a < b, "le": lambda b: a <= b, "gt": lambda b: a > b, "ge": lambda b: a >= b}
    return Value("truth", reduce(lambda x, y: x | y, [tests[name](b) for b in rest]))


def _formatted(form: Value, *values: Value) -> Value:
    if form.literal is None:
        raise TemplateError("printf takes a literal format")
    out, columns, at, left = [], [], 0, list(values)
    for m in VERB.finditer(form.literal):
        out.append(form.literal[at : m.start()].replace("%", "%%"))
        at = m.end()
        flags, verb = m.groups()
        if verb == "%":
            out.append("%%")
            continue
        if not left:
            raise TemplateError("printf lacks a value")
        value = left.pop(0)
        if verb in "dxX" and value.kind == "number" or verb == "v" and value.kind == "number":
            out.append(f"%{flags}{'d' if verb == 'v' else verb}")
            columns.append(value.column)
        elif verb in "svqt" and verb != "t" or verb == "t" and value.kind == "truth":
            quoted = F.concat(F.lit('"'), F.regexp_replace(_printed(value), r'(["\\])', r"\\$1"), F.lit('"'))
            out.append(f"%{flags.replace('0', '', 1) if flags.startswith('0') else flags}s")
            columns.append(quoted if verb == "q" else _printed(value))
        else:
            raise TemplateError(f"printf cannot show a {value.kind} as %{verb}")
    if left:
        raise TemplateError("printf has values over")
    return Value("text", F.format_string("".join(out) + form.literal[at:].replace("%", "%%"), *columns) if columns else F.lit(("".join(out) + form.literal[at:]).replace("%%", "%")))


def _call(name: str, values: list[Value]) -> Value:
    if name in ("slug", "lower", "upper") and len(values) == 1:
        return Value("text", {"slug": slug, "lower": F.lower, "upper": F.upper}[name](_as(values[0], "text", "")))
    if name == "join" and len(values) == 2:
        parts, by = _as(values[0], "list"), _as(values[1], "text", "")
        joined = F.array_join(parts, values[1].literal) if values[1].literal is not None else F.aggregate(parts, F.lit(None).cast("string"), lambda x, p: F.when(x.isNull(), p).otherwise(F.concat(x, by, p)))
        return Value("text", F.coalesce(joined, F.lit("")))
    if name in ("eq", "ne", "lt", "le", "gt", "ge") and values:
        return _compared(name, *values)
    if name in ("and", "or") and values:
        *before, last = values
        return reduce(lambda done, v: _choice(_holds(v), *((done, v) if name == "and" else (v, done))), reversed(before), last)
    if name == "not" and len(values) == 1:
        return Value("truth", ~_holds(values[0]))
    if name == "len" and len(values) == 1:
        return _length(values[0])
    if name == "index" and values:
        return _index(*values)
    if name == "slice" and 1 <= len(values) <= 3:
        return _slice(*values)
    if name == "printf" and values:
        return _formatted(*values)
    if name == "print" and values:  # a blank between two values of which none is a text
        out = [_printed(values[0])]
        for x, y in zip(values, values[1:], strict=False):
            out += [F.lit("" if "text" in (x.kind, y.kind) else " "), _printed(y)]
        return Value("text", F.concat(*out))
    raise TemplateError(f"unknown function {name}, or a wrong number of values for it")


def _value(word: str, dot: Value, names: dict[str, Value]) -> Value:
    if word[0] == '"':
        return _text(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.S))
    if word[0] == "`":
        return _text(word[1:-1])
    if word in ("true", "false"):
        return Value("truth", F.lit(word == "true"))
    if re.fullmatch(r"[-+]?\d+", word):
        return Value("number", F.lit(int(word)).cast("long"))
    head, *path = word.split(".")
    if not head.startswith("$") and head:
        raise TemplateError(f"{word!r} is no value")
    if head and head not in names:
        raise TemplateError(f"unknown variable {head}")
    return reduce(_field, [p for p in path if p] if word != "." else [], names[head] if head else dot)


def _pipeline(words: list[str], dot: Value, names: dict[str, Value]) -> Value:
    """Values, parentheses and calls; a pipe hands its left side over as the last argument."""
    parts, depth = [[]], 0
    for w in words:
        depth += (w == "(") - (w == ")")
        if w == "|" and not depth:
            parts.append([])
        else:
            parts[-1].append(w)
    carried = None
    for part in parts:
        items, k = [], 0
        while k < len(part):
            end = k + 1
            if part[k] == "(":
                depth = 1
                while depth:
                    if end >= len(part):
                        raise TemplateError("unclosed parenthesis")
                    depth += (part[end] == "(") - (part[end] == ")")
                    end += 1
                items.append(_pipeline(part[k + 1 : end - 1], dot, names))
            else:
                items.append(part[k])
            k = end
        if not items:
            raise TemplateError("empty action")
        call = isinstance(items[0], str) and items[0].isidentifier() and items[0] not in ("true", "false")
        values = [x if isinstance(x, Value) else _value(x, dot, names) for x in items[call:]] + ([carried] if carried else [])
        if call:
            carried = _call(items[0], values)
        elif len(values) > 1:
            raise TemplateError(f"{items[0]} is no function")
        else:
            carried = values[0]
    return carried


def _words(action: str) -> list[str]:
    out, k, text = [], 0, action.strip()
    while k < len(text):
        if not (w := WORD.match(text, k)):
            raise TemplateError(f"unexpected {text[k:]!r}")
        out.append(w[1])
        k = w.end()
    return out


def _pieces(template: str) -> list[str | list[str]]:
    """Texts and the words of actions, in turn."""
    out, at, trim = [], 0, False
    for m in ACTION.finditer(template):
        text = template[at : m.start()]
        if "{{" in text:
            raise TemplateError("unclosed action")
        text = text.lstrip() if trim else text
        out.append(text.rstrip() if m[1] else text)
        if not m[2].strip().startswith("/*"):
            out.append(_words(m[2]))
        at, trim = m.end(), bool(m[3])
    if "{{" in template[at:]:
        raise TemplateError("unclosed action")
    return [*out, template[at:].lstrip() if trim else template[at:]]


def _tree(pieces: list, inside: bool = False) -> tuple[list, list[str] | None]:
    """Nodes up to the end (or the else, whose words are returned); takes what it reads from pieces."""
    nodes = []
    while pieces:
        piece = pieces.pop(0)
        if isinstance(piece, str):
            nodes.append(piece)
        elif not piece:
            raise TemplateError("empty action")
        elif piece[0] in ("end", "else"):
            if not inside:
                raise TemplateError(f"unexpected {piece[0]}")
            return nodes, piece
        elif piece[0] in ("if", "with", "range"):
            nodes.append(_branch(piece, pieces))
        elif piece[0] in ("define", "template", "block", "break", "continue"):
            raise TemplateError(f"{piece[0]} is not supported")
        else:
            nodes.append(piece)
    if inside:
        raise TemplateError("a block is not ended")
    return nodes, None


def _branch(piece: list[str], pieces: list) -> tuple:
    body, last = _tree(pieces, True)
    other: list = []
    if last[0] == "else" and len(last) > 1:  # else if, else with: a block of its own, ended together with this one
        other = [_branch(last[1:], pieces)]
    elif last[0] == "else":
        other, last = _tree(pieces, True)
        if last[0] != "end":
            raise TemplateError("a second else")
    return piece[0], piece[1:], body, other


def _declared(words: list[str]) -> tuple[list[str], list[str]]:
    """The variables that `$x :=` or `$i, $x :=` names, and the rest."""
    if ":=" not in words:
        return [], words
    k = words.index(":=")
    named = [w for w in words[:k] if w != ","]
    if not named or len(named) > 2 or any(not re.fullmatch(r"\$\w+", w) for w in named):
        raise TemplateError("a variable is expected before :=")
    return named, words[k + 1 :]


def _render(nodes: list, dot: Value, names: dict[str, Value]) -> Column:
    out, names = [F.lit("")], dict(names)
    for node in nodes:
        if isinstance(node, str):
            out.append(F.lit(node))
        elif isinstance(node, list):
            named, words = _declared(node)
            value = _pipeline(words, dot, names)
            if named:
                names[named[0]] = value
            else:
                out.append(_printed(value))
        else:
            out.append(_rendered_branch(*node, dot, names))
    return F.concat(*out)


def _rendered_branch(name: str, words: list[str], body: list, other: list, dot: Value, names: dict[str, Value]) -> Column:
    named, words = _declared(words)
    value = _pipeline(words, dot, names)
    no = _render(other, dot, names)
    if name != "range":
        inner = names | ({named[0]: value} if named else {})
        return F.when(_holds(value), _render(body, value if name == "with" else dot, inner)).otherwise(no)
    if value.kind == "map":
        items, key = F.array_sort(F.map_keys(value.column)), lambda k, _: (Value("text", k), Value("text", F.try_element_at(value.column, k)))
    elif value.kind == "sources":
        items, key = F.array_sort(F.array_distinct(F.transform("tag_rows", lambda t: t["source"]))), lambda k, _: (Value("text", k), _of_source(k))
    elif value.kind == "list":
        items, key = value.column, lambda x, k: (Value("number", k.cast("long")), Value("text", x))
    else:
        raise TemplateError(f"cannot range over a {value.kind}")

    def one(x, k):
        place, item = key(x, k)
        given = dict(zip(named, (place, item), strict=True)) if len(named) == 2 else dict.fromkeys(named, item)
        return _render(body, item, names | given)

    return F.when(_holds(value), F.array_join(F.transform(items, one), "")).otherwise(no)


def render(template: str) -> Column:
    """The template as a Column over sample columns, tags (array of names), tag_rows, attributes and metadata.

    A key that is not there prints as "<no value>" and is an empty text to functions."""
    nodes, _ = _tree(_pieces(template))
    return _render(nodes, ROOT, {"$": ROOT})


def clean(path: Column) -> Column:
    """The path without doubled slashes, "." parts and a last slash, ".." taking away what stands before it."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    rooted = F.startswith(path, F.lit("/"))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((p == "..") & rooted, acc)
        .otherwise(F.concat(acc, F.array(p))),
    )
    joined = F.array_join(kept, "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def rename_target(rendered: Column, source_root: Column, extension: Column) -> Column:
    """A rendered name as a path: blank fails, a missing extension is added, relative names go below the root."""
    bare = F.trim(rendered)
    last = F.substring_index(bare, "/", -1)
    named = F.when(~last.contains(".") & (F.coalesce(extension, F.lit("")) != ""), F.concat(bare, F.lit("."), extension)).otherwise(bare)
    full = F.when(F.startswith(named, F.lit("/")), named).otherwise(F.concat(source_root, F.lit("/"), named))
    return F.when(bare == "", F.raise_error(F.lit("the template gave an empty path")).cast("string")).otherwise(clean(full))


def by_tags(base: str, file_name: Column, tags: Column, depth: int = 0) -> Column:
    """base / the sorted slugs of the distinct tags (the first `depth`, if over 0) / file name."""
    names = F.array_sort(F.transform(distinct_first(tags), slug))
    folders = F.slice(names, 1, depth) if depth > 0 else names
    return clean(F.array_join(F.concat(F.array(F.lit(base)), folders, F.array(file_name)), "/"))


def by_cluster(base: str, file_name: Column, label: Column) -> Column:
    folder = F.coalesce(F.nullif(slug(F.coalesce(label, F.lit(""))), F.lit("")), F.lit("unclustered"))
    return clean(F.concat_ws("/", F.lit(base), folder, file_name))
