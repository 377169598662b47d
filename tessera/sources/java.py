"""Java source to declarations: a token scanner with brace matching, run over batches of files.

The scanner drops comments and literals, then walks type bodies member by member. It needs no
grammar library and never fails on broken source: what it can't read it skips to the next member.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Folders that are never searched.
SKIPPED_FOLDERS = ".git target build out .idea .gradle .mvn node_modules".split()

TOKEN = re.compile(
    r'(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>""".*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?)'
    r"|(?P<word>[A-Za-z_$\u0080-￿][\w$\u0080-￿]*)|(?P<number>\d[\w.]*)|(?P<sign>->|::|\.\.\.|.)",
    re.S,
)
MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed non-sealed".split())
KINDS = frozenset(("class", "interface", "enum", "record"))
#: Words before a parenthesis that aren't calls.
NOT_CALLS = frozenset("if for while switch catch synchronized return throw try new super this assert else do case instanceof yield".split())
PRIMITIVES = frozenset("int long short byte char float double boolean void".split())
OPEN, CLOSE = {"(": ")", "{": "}", "[": "]"}, frozenset(")}]")

CALL = "struct<name:string,receiver:string,arg_count:int,line:bigint,col:bigint>"
METHOD = f"struct<name:string,signature:string,return_type:string,modifiers:array<string>,is_constructor:boolean,line:bigint,col:bigint,line_end:bigint,body_hash:string,local_types:map<string,string>,calls:array<{CALL}>>"
CLASS = f"struct<kind:string,name:string,fqcn:string,line:bigint,col:bigint,extends:array<string>,interfaces:array<string>,field_types:map<string,string>,body_hash:string,methods:array<{METHOD}>>"
PARSED = f"package string, imports array<string>, classes array<{CLASS}>"


class Tokens:
    """Tokens of a source with their places and the partner of every bracket."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.text: list[str] = []
        self.at: list[int] = []
        self.word: list[bool] = []
        for m in TOKEN.finditer(source):
            if m.lastgroup == "skip":
                continue
            self.text.append('""' if m.lastgroup == "text" else m[0])
            self.at.append(m.start())
            self.word.append(m.lastgroup == "word")
        n = len(self.text)
        self.partner = [n] * n
        stack: list[int] = []
        for i, t in enumerate(self.text):
            if t in OPEN:
                stack.append(i)
            elif t in CLOSE:
                while stack and OPEN[self.text[stack[-1]]] != t:
                    stack.pop()
                if stack:
                    self.partner[stack.pop()] = i
        self.lines = [m.start() for m in re.finditer("\n", source)]

    def place(self, i: int) -> tuple[int, int]:
        import bisect

        offset = self.at[i]
        row = bisect.bisect_left(self.lines, offset)
        return row + 1, offset - (self.lines[row - 1] + 1 if row else 0) + 1

    def __len__(self) -> int:
        return len(self.text)

    def get(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else ""

    def past_angles(self, i: int) -> int:
        """Index after a bracketed type list that opens at i."""
        depth = 0
        while i < len(self.text):
            t = self.text[i]
            depth += (t == "<") - (t == ">")
            if t in (";", "{", "}") and depth:
                return i
            i += 1
            if not depth:
                return i
        return i

    def type_at(self, i: int) -> tuple[str, int]:
        """A type's name without arguments and brackets, and the index after it; an empty name if there is none."""
        while self.get(i) == "@":
            i = self.past_annotation(i)
        if not (i < len(self) and self.word[i]) or self.text[i] in KINDS and self.get(i + 1) != "<" and self.text[i] != "record":
            return "", i
        name, i = self.text[i], i + 1
        while True:
            if self.get(i) == "<":
                i = self.past_angles(i)
            elif self.get(i) == "." and i + 1 < len(self) and self.word[i + 1]:
                name += "." + self.text[i + 1]
                i += 2
            elif self.get(i) == "[" and self.partner[i] == i + 1:
                i += 2
            elif self.get(i) == "@":
                i = self.past_annotation(i)
            else:
                return name, i

    def past_annotation(self, i: int) -> int:
        i += 2
        while self.get(i) == "." and i + 1 < len(self) and self.word[i + 1]:
            i += 2
        return self.partner[i] + 1 if self.get(i) == "(" else i

    def modifiers(self, i: int) -> tuple[list[str], int]:
        """Modifiers and annotations ('@' and the name, no arguments) before a declaration."""
        found = []
        while i < len(self):
            if self.text[i] == "@" and self.get(i + 1) != "interface":
                end = self.past_annotation(i)
                name = "".join(self.text[i:end]).split("(")[0]
                found.append(name)
                i = end
            elif self.text[i] == "non" and self.get(i + 1) == "-":
                found.append("non-sealed")
                i += 3
            elif self.text[i] in MODIFIERS and self.get(i + 1) not in (";", "=", "(", ","):
                found.append(self.text[i])
                i += 1
            else:
                break
        return found, i

    def hash_of(self, i: int, j: int) -> str:
        """SHA-1 of the tokens from i up to j: comments and layout don't matter, literals do."""
        if i >= len(self):
            return hashlib.sha1(b"").hexdigest()
        end = self.at[j] if j < len(self) else len(self.source)
        parts = [m[0] for m in TOKEN.finditer(self.source[self.at[i] : end]) if m.lastgroup != "skip"]
        return hashlib.sha1(" ".join(parts).encode("utf-8", "replace")).hexdigest()


def _type_list(t: Tokens, i: int) -> tuple[list[str], int]:
    names = []
    while True:
        name, i = t.type_at(i)
        if name:
            names.append(name)
        if t.get(i) != ",":
            return names, i
        i += 1


def _parameters(t: Tokens, i: int) -> tuple[list[str], dict[str, str]]:
    """Types of a parameter list that opens at i, and types by name."""
    types, named, end = [], {}, t.partner[i]
    i += 1
    while i < end:
        _, i = t.modifiers(i)
        name, j = t.type_at(i)
        if not name:
            i += 1
            continue
        j += t.get(j) == "..."
        types.append(name)
        if j < end and t.word[j]:
            named[t.text[j]] = name
        depth = 0
        while j < end and (depth or t.text[j] != ","):
            j = t.partner[j] if t.text[j] in OPEN and t.partner[j] < end else j
            j += 1
        i = j + 1
    return types, named


def _arguments(t: Tokens, i: int) -> int:
    """Number of arguments of a call that opens at i; commas inside nested brackets don't count."""
    end, n, j = min(t.partner[i], len(t)), 0, i + 1
    if j >= end:
        return 0
    angle = 0
    while j < end:
        if t.text[j] in OPEN:
            j = min(t.partner[j], end)
        elif t.text[j] == "<" and t.get(j - 1) in ("new", ".") or t.text[j] == "<" and t.get(j - 1)[:1].isupper():
            angle += 1
        elif t.text[j] == ">" and angle:
            angle -= 1
        elif t.text[j] == "," and not angle:
            n += 1
        j += 1
    return n + 1


def _receiver(t: Tokens, i: int) -> str | None:
    """Text before the dot at i: a name, a dotted name, or a call's or array's text."""
    j = i - 1
    back = {v: k for k, v in ((k, t.partner[k]) for k in range(max(0, i - 400), i) if t.text[k] in OPEN)}
    while j >= 0:
        if t.text[j] in (")", "]") and j in back:
            j = back[j] - 1
            if j >= 0 and t.word[j] and t.text[j] not in NOT_CALLS:
                j -= 1
        elif t.word[j] or t.text[j] == '""':
            j -= 1
        else:
            break
        if j >= 0 and t.text[j] == ".":
            j -= 1
            continue
        if j >= 0 and t.text[j] == "new":
            j -= 1
        break
    text = "".join(x + " " if x == "new" else x for x in t.text[j + 1 : i])
    return text or None


def _body(t: Tokens, i: int) -> tuple[list[dict], dict[str, str]]:
    """Calls and local variable types of the block that opens at i."""
    calls, local, end = [], {}, min(t.partner[i], len(t))
    j = i + 1
    while j < end:
        if t.word[j]:
            if t.get(j + 1) == "(" and t.text[j] not in NOT_CALLS and t.get(j - 1) not in ("new", "@"):
                line, col = t.place(j)
                receiver = _receiver(t, j - 1) if t.get(j - 1) == "." else None
                calls.append({"name": t.text[j], "receiver": receiver, "arg_count": _arguments(t, j + 1), "line": line, "col": col})
            elif t.get(j - 1) in (";", "{", "}", "(", ")", "final", ":", "->") and t.text[j] not in NOT_CALLS and (t.get(j - 1) != ")" or True):
                name, k = t.type_at(j)
                if name and k < end and t.word[k] and t.text[k] not in ("instanceof",) and t.get(k + 1) in ("=", ";", ":", ",") and name not in ("return", "throw", "package", "import", "goto", "break", "continue"):
                    while True:
                        local[t.text[k]] = name
                        k += 1
                        while k < end and t.text[k] not in (",", ";", ")", ":"):
                            k = t.partner[k] + 1 if t.text[k] in OPEN else k + 1
                        if t.get(k) == "," and k + 1 < end and t.word[k + 1] and t.get(k + 2) in ("=", ";", ","):
                            k += 1
                            continue
                        break
        j += 1
    return calls, local


def _member_end(t: Tokens, i: int, end: int) -> int:
    """Index after the member that i is in: past its semicolon or block."""
    while i < end:
        if t.text[i] == ";":
            return i + 1
        if t.text[i] == "{":
            return min(t.partner[i], end) + 1
        i = min(t.partner[i], end) + 1 if t.text[i] in OPEN else i + 1
    return end


def _type_body(t: Tokens, i: int, outer: list[str], package: str, flat: bool, out: list[dict]) -> int:
    """Read the type declaration whose keyword is at i; the index after it."""
    start, kind = i, "annotation" if t.text[i] == "@" else t.text[i]
    i += 2 if kind == "annotation" else 1
    if not (i < len(t) and t.word[i]):
        return i
    name = t.text[i]
    line, col = t.place(i)
    i += 1
    if t.get(i) == "<":
        i = t.past_angles(i)
    fields: dict[str, str] = {}
    if kind == "record" and t.get(i) == "(":
        fields |= _parameters(t, i)[1]
        i = t.partner[i] + 1
    extends, interfaces = [], []
    while i < len(t) and t.text[i] != "{":
        if t.text[i] == "extends":
            found, i = _type_list(t, i + 1)
            extends += found
        elif t.text[i] == "implements":
            found, i = _type_list(t, i + 1)
            interfaces += found
        elif t.text[i] == "permits":
            _, i = _type_list(t, i + 1)
        elif t.text[i] in (";", "}"):
            return i + 1
        else:
            i += 1
    if i >= len(t):
        return i
    names = [name] if flat else [*outer, name]
    end = min(t.partner[i], len(t))
    methods: list[dict] = []
    own = {"kind": kind, "name": name, "fqcn": ".".join(filter(None, [package, *names])), "line": line, "col": col, "extends": extends, "interfaces": interfaces, "field_types": fields, "methods": methods}
    out.append(own)
    own["body_hash"] = t.hash_of(start, end + 1)
    i += 1
    if kind == "enum":
        while i < end and t.text[i] != ";":
            i = min(t.partner[i], end) + 1 if t.text[i] in OPEN else i + 1
        i += 1
    while i < end:
        if t.text[i] in (";", "}"):
            i += 1
            continue
        first = i
        marks, i = t.modifiers(i)
        if i >= end:
            break
        if t.text[i] == "{":
            i = t.partner[i] + 1
            continue
        if t.text[i] in KINDS and (t.text[i] != "record" or t.get(i + 2) in ("(", "<")) and i + 1 < end and t.word[i + 1] or t.text[i] == "@" and t.get(i + 1) == "interface":
            i = _type_body(t, i, names, package, flat, out)
            continue
        if t.text[i] == "<":
            i = t.past_angles(i)
        built = t.get(i) == name and t.get(i + 1) in ("(", "{")
        kind_of, j = (name, i) if built else t.type_at(i)
        if not kind_of or j >= end or not t.word[j]:
            i = max(_member_end(t, i, end), first + 1)
            continue
        member = t.text[j]
        if t.get(j + 1) == "(" or built:
            types, named = _parameters(t, j + 1) if t.get(j + 1) == "(" else ([], {})
            k = t.partner[j + 1] + 1 if t.get(j + 1) == "(" else j + 1
            while k < end and t.text[k] not in ("{", ";"):
                k += 1
            row, column = t.place(j)
            one = {"name": member, "signature": f"{member}({','.join(types)})", "return_type": kind_of, "modifiers": marks, "is_constructor": built, "line": row, "col": column, "line_end": row, "local_types": {}, "calls": [], "parameters": named, "has_body": t.get(k) == "{"}
            if one["has_body"]:
                one["calls"], one["local_types"] = _body(t, k)
                last = min(t.partner[k], len(t) - 1)
                one["line_end"] = t.place(last)[0]
                one["body_hash"] = t.hash_of(first, last + 1)
            else:
                one["body_hash"] = t.hash_of(first, k)
            methods.append(one)
            i = t.partner[k] + 1 if one["has_body"] else k + 1
            continue
        k = j
        while True:
            fields[t.text[k]] = kind_of
            k += 1
            while k < end and t.text[k] not in (",", ";"):
                k = min(t.partner[k], end) + 1 if t.text[k] in OPEN else k + 1
            if t.get(k) == "," and k + 1 < end and t.word[k + 1]:
                k += 1
                continue
            break
        i = k + 1
    return end + 1


def parse(source: str, all_types: bool = False, flat_names: bool = False, parameters_as_locals: bool = False) -> dict:
    """package, imports and classes of a source.

    By default only classes and methods with a body count; ``all_types`` adds interfaces, enums,
    records and bodiless methods. ``flat_names`` leaves outer classes out of nested names.
    ``parameters_as_locals`` lets parameters take part in receiver types.
    """
    t = Tokens(source)
    package, imports, classes = "", [], []
    i = 0
    while i < len(t):
        word = t.text[i]
        if word in ("package", "import") and t.word[i]:
            j = i + 1
            while j < len(t) and t.text[j] != ";":
                j += 1
            name = "".join(t.text[i + 1 : j] if t.get(i + 1) != "static" else t.text[i + 2 : j])
            if word == "package":
                package = name
            else:
                imports.append(name)
            i = j + 1
        elif (word in KINDS and i + 1 < len(t) and t.word[i + 1]) or word == "@" and t.get(i + 1) == "interface":
            i = _type_body(t, i, [], package, flat_names, classes)
        else:
            i += 1
    kept = []
    for c in classes:
        if not all_types and c["kind"] != "class":
            continue
        methods = [m for m in c["methods"] if all_types or m["has_body"]]
        for m in methods:
            named, _ = m.pop("parameters"), m.pop("has_body")
            if parameters_as_locals:
                m["local_types"] = named | m["local_types"]
        kept.append({**c, "methods": methods})
    return {"package": package, "imports": imports, "classes": kept}


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path, rel_path, mtime, size, content of the Java files below the source folders of a tree."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.java").load(root)
    plain = F.regexp_replace("path", "^[a-z]+:/+", "/")
    base = root.split(":", 1)[-1].rstrip("/")
    base = "/" + base.lstrip("/")
    rel = F.substring(plain, len(base) + 2, 1 << 20)
    inside = F.concat(F.lit("/"), rel)
    skip = "/(" + "|".join(re.escape(f) for f in SKIPPED_FOLDERS) + ")/"
    rows = found.select(plain.alias("path"), rel.alias("rel_path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
    return rows.where(~inside.rlike(skip) & inside.contains("/src/"))


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, mtime, size, content of the named files that exist."""
    plain = F.regexp_replace("path", "^[a-z]+:/+", "/")
    there = [p for p in paths if _exists(spark, p)]
    if not there:
        return spark.createDataFrame([], "path string, mtime timestamp, size bigint, content binary")
    found = spark.read.format("binaryFile").load(there)
    return found.select(plain.alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def parsed(files: DataFrame, columns: list[str], content: str = "content", **options) -> DataFrame:
    """The chosen columns of each file with its package, imports and classes."""
    types = ", ".join([f"`{c}` {files.schema[c].dataType.simpleString()}" for c in columns] + [PARSED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for raw in batch.column(content):
                raw = raw.as_py()
                found.append(parse(raw.decode("utf-8", "ignore") if isinstance(raw, bytes) else raw or "", **options))
            for f in found:
                for c in f["classes"]:
                    c["field_types"] = list(c["field_types"].items())
                    for m in c["methods"]:
                        m["local_types"] = list(m["local_types"].items())
            arrow = batch_schema
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array([f[n] for f in found], arrow.field(n).type) for n in ("package", "imports", "classes")], names=[*columns, "package", "imports", "classes"])

    batch_schema = _arrow_schema()
    return files.select(*dict.fromkeys([*columns, content])).mapInArrow(run, types)


def _arrow_schema() -> pa.Schema:
    text, number = pa.string(), pa.int64()
    call = pa.struct([("name", text), ("receiver", text), ("arg_count", pa.int32()), ("line", number), ("col", number)])
    pairs = pa.map_(text, text)
    method = pa.struct([("name", text), ("signature", text), ("return_type", text), ("modifiers", pa.list_(text)), ("is_constructor", pa.bool_()), ("line", number), ("col", number), ("line_end", number), ("body_hash", text), ("local_types", pairs), ("calls", pa.list_(call))])
    kind = pa.struct([("kind", text), ("name", text), ("fqcn", text), ("line", number), ("col", number), ("extends", pa.list_(text)), ("interfaces", pa.list_(text)), ("field_types", pairs), ("body_hash", text), ("methods", pa.list_(method))])
    return pa.schema([("package", text), ("imports", pa.list_(text)), ("classes", pa.list_(kind))])
