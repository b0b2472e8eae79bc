"""Word files without a Word library: paragraphs and runs from the zipped XML, and highlighted copies.

A paragraph is read through its runs, symbol elements, formulas, deleted text and unknown
wrappers. Each run keeps both its raw and its normalised extent, so spans found in normalised
text can be carried back. Field codes are dropped and their results kept."""

from __future__ import annotations

import copy
import io
import itertools
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import symbols as Y

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
_WIDTHS = str.maketrans(N.WIDE + N.HALF_KANA, N.NARROW + N.FULL_KANA)
_SYMBOL_FONT = str.maketrans(Y.SYMBOL_FONT, Y.SYMBOL_FONT_TO)
_PRIVATE = dict(zip(map(ord, Y.PRIVATE), Y.PRIVATE_TO))


def _plain(text: str, symbol_font: bool = False) -> str:
    if symbol_font:
        text = text.translate(_SYMBOL_FONT)
    return "".join(" " if 0xF000 <= ord(c) <= 0xF0FF else c for c in text.replace("∆", "Δ"))


def symbol(code: str) -> str:
    try:
        n = int(code, 16)
    except ValueError:
        return code
    return _PRIVATE.get(n, " " if 0xF000 <= n <= 0xF0FF else code)


def formula(e: ET.Element) -> str:
    """A formula's text; superscripts as ``^(...)``."""
    if e.tag in (M + "t", W + "t"):
        return _plain(e.text or "")
    inner = "".join(map(formula, e))
    return f"^({inner})" if e.tag == M + "sup" and inner else inner


@dataclass
class Run:
    kind: str
    raw: str
    text: str
    element: ET.Element = field(repr=False, default=None)
    part: ET.Element = field(repr=False, default=None)


def normal(text: str) -> str:
    """Quotes, blanks and widths of a paragraph, as in ``normalize.short_line``."""
    for p, r in N.compiled(N.SPACES + N.QUOTES):
        text = p.sub(r, text)
    return text.translate(_WIDTHS)


class Fields:
    """Which parts of a paragraph's runs belong to field codes; a field's result does not."""

    def __init__(self):
        self.open: list[bool] = []  # for each open field, whether its code still runs

    def meets(self, part: ET.Element) -> bool:
        """Whether the part is a field's mark or lies in a field's code."""
        if part.tag != W + "fldChar":
            return any(self.open)
        kind = part.get(W + "fldCharType")
        if kind == "begin":
            self.open.append(True)
        elif self.open and kind == "separate":
            self.open[-1] = False
        elif self.open and kind == "end":
            self.open.pop()
        return True


def runs(paragraph: ET.Element) -> list[Run]:
    out: list[Run] = []
    fields = Fields()

    def walk(e: ET.Element) -> None:
        if e.tag == W + "r":
            fonts = e.find(f"{W}rPr/{W}rFonts")
            in_symbol = fonts is not None and any("Symbol" == v for v in fonts.attrib.values())
            for c in e:
                if fields.meets(c):
                    continue
                if c.tag in (W + "t", W + "delText"):
                    out.append(Run("text", c.text or "", _plain(c.text or "", in_symbol), e, c))
                elif c.tag == W + "sym":
                    out.append(Run("symbol", " ", symbol(c.get(W + "char") or "") or " ", e, c))
                elif c.tag in (W + "tab", W + "br"):
                    out.append(Run("break", " ", " ", e, c))
        elif e.tag in (M + "oMath", M + "oMathPara"):
            out.append(Run("math", "".join(e.itertext()), formula(e), e, e))
        elif e.tag not in (W + "pPr", W + "rPr", W + "instrText"):
            for c in e:
                walk(c)

    for c in paragraph:
        walk(c)
    return out


def paragraphs(content: bytes) -> list[tuple[str, list[Run]]]:
    """(normalised text, runs) of every paragraph of the body, tables' too."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(W + "body")
    got = [runs(p) for p in body.iter(W + "p")]
    return [(normal("".join(r.text for r in rs)), rs) for rs in got]


def starts(rs: list[Run]) -> list[int]:
    """Where each run begins in its paragraph's normalised text; normalising keeps lengths."""
    return [0, *itertools.accumulate(len(r.text) for r in rs)][: len(rs)]


def read(files: DataFrame) -> DataFrame:
    """``files(path, content)`` -> ``(path, para_no, text, runs, error)``; a broken file gives one row that says why."""
    run_type = "array<struct<kind:string,raw:string,text:string,start:int>>"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow_runs = pa.list_(pa.struct([("kind", pa.string()), ("raw", pa.string()), ("text", pa.string()), ("start", pa.int32())]))
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    got, error = [(t, [{"kind": r.kind, "raw": r.raw, "text": r.text, "start": at} for r, at in zip(rs, starts(rs))]) for t, rs in paragraphs(content)], None
                except Exception as e:  # a file's fault stays with the file
                    got, error = [(None, [])], f"{type(e).__name__}: {e}"
                n = len(got)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array([t for t, _ in got], pa.string()), pa.array([r for _, r in got], arrow_runs), pa.array([error] * n, pa.string())],
                    names=["path", "para_no", "text", "runs", "error"],
                )

    return files.select("path", "content").mapInArrow(parse, f"path string, para_no int, text string, runs {run_type}, error string")


def texts(files: DataFrame) -> DataFrame:
    """``(path, text)``: a file's paragraphs joined by line feeds, empty ones skipped."""
    ordered = F.sort_array(F.collect_list(F.struct("para_no", "text")))
    return read(files).filter("error is null and text <> ''").groupBy("path").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def run_table(paragraphs: DataFrame) -> DataFrame:
    """``read``'s rows as the run map of ``locate.runs_of``; ``line_no`` is the paragraph."""
    one = paragraphs.filter("error is null").select("path", F.col("para_no").alias("line_no"), F.posexplode("runs").alias("run_no", "r"))
    return one.select("path", "line_no", "run_no", F.col("r.start").alias("tx_start"), F.length("r.text").alias("tx_len"), F.lit(0).alias("orig_start"))


#: Shading colours of the classes.
FILL = {"LightPink": "FFB6C1", "Cyan": "00FFFF", "Yellow": "FFFF00", "LightGreen": "90EE90"}


#: Run properties that the format puts behind the shading.
_BEHIND = {W + t for t in ("fitText", "vertAlign", "rtl", "cs", "em", "lang", "eastAsianLayout", "specVanish", "oMath")}
_SPACE = "{http://www.w3.org/XML/1998/namespace}space"


def _shade(run: ET.Element, fill: str) -> None:
    props = run.find(W + "rPr")
    if props is None:
        props = ET.Element(W + "rPr")
        run.insert(1 if run.find(M + "rPr") is not None else 0, props)
    for old in props.findall(W + "shd"):
        props.remove(old)
    at = next((i for i, c in enumerate(props) if c.tag in _BEHIND), len(props))
    props.insert(at, ET.Element(W + "shd", {W + "val": "clear", W + "color": "auto", W + "fill": fill}))


def _without_codes(e: ET.Element, fields: Fields) -> None:
    """Drop field marks and codes below ``e`` and keep the results; simple fields are unwrapped."""
    kept = []
    for c in e:
        if c.tag in (W + "instrText", W + "delInstrText") or (e.tag == W + "r" and c.tag != W + "rPr" and fields.meets(c)):
            continue
        _without_codes(c, Fields() if c.tag == W + "p" else fields)
        kept += list(c) if c.tag == W + "fldSimple" else [c]
    e[:] = kept


def _split(p: ET.Element, parts: list[tuple[int, int, str]]) -> None:
    """Cut the runs of a paragraph at the parts' ends (inclusive offsets in its normalised text) and shade the
    pieces inside; later parts win. Symbols, breaks and formulas are shaded whole."""
    rs = runs(p)
    fills: list[str | None] = [None] * sum(len(r.text) for r in rs)
    for begin, end, fill in parts:
        begin, end = max(begin, 0), min(end, len(fills) - 1)
        fills[begin : end + 1] = [fill] * max(0, end - begin + 1)
    pieces: dict[ET.Element, dict[ET.Element, list[tuple[ET.Element, str | None]]]] = {}
    for r, at in zip(rs, starts(rs)):
        inside = fills[at : at + len(r.text)]
        whole = next((f for f in inside if f), None)
        if r.kind == "math":
            for m in r.element.iter(M + "r") if whole else ():
                _shade(m, whole)
            continue
        got = pieces.setdefault(r.element, {}).setdefault(r.part, [])
        if r.kind != "text" or len(set(inside)) < 2:
            got.append((r.part, whole))
            continue
        for fill, group in itertools.groupby(zip(inside, r.raw), key=lambda x: x[0]):
            piece = ET.Element(r.part.tag, r.part.attrib | {_SPACE: "preserve"})
            piece.text = "".join(c for _, c in group)
            got.append((piece, fill))
    above = {c: e for e in p.iter() for c in e}
    for run, by_part in pieces.items():
        if not any(fill for got in by_part.values() for _, fill in got):
            continue
        props = run.find(W + "rPr")
        every = [x for c in run if c is not props for x in by_part.get(c, [(c, None)])]
        made = []
        for fill, group in itertools.groupby(every, key=lambda x: x[1]):
            new = ET.Element(run.tag, run.attrib)
            if props is not None:
                new.append(copy.deepcopy(props))
            new.extend(c for c, _ in group)
            if fill:
                _shade(new, fill)
            made.append(new)
        e = above[run]
        at = list(e).index(run)
        e[at : at + 1] = made


def written(root: ET.Element, data: bytes) -> bytes:
    """``root`` as XML that declares every prefix of the input it came from: other parts of the format name
    prefixes in attribute values, so none may be renamed or lost."""
    prefixes: dict[str, str] = {}
    for _, (prefix, uri) in ET.iterparse(io.BytesIO(data), events=["start-ns"]):
        if not prefix or prefixes.get(prefix, uri) != uri:  # a default, or a second meaning
            prefix = next(p for n in itertools.count() if prefixes.get(p := f"q{n}", uri) == uri)
        prefixes[prefix] = uri
    of = {uri: prefix for prefix, uri in reversed(prefixes.items())} | {"http://www.w3.org/XML/1998/namespace": "xml"}
    prefixes.pop("xml", None)
    out: list[str] = []

    def name(tag: str) -> str:
        uri, _, local = tag[1:].rpartition("}") if tag.startswith("{") else ("", "", tag)
        if uri and uri not in of:
            of[uri] = next(p for n in itertools.count() if (p := f"q{n}") not in prefixes)
            prefixes[of[uri]] = uri
        return f"{of[uri]}:{local}" if uri else local

    def put(e: ET.Element) -> None:
        tag = name(e.tag)
        out.append(f"<{tag}" + "".join(f" {name(k)}={quoteattr(v)}" for k, v in e.attrib.items()))
        if e is root:
            out.append(None)
        out.append(">" + escape(e.text or "", {"\r": "&#13;"}))
        for c in e:
            put(c)
            out.append(escape(c.tail or "", {"\r": "&#13;"}))
        out.append(f"</{tag}>")

    put(root)
    out[out.index(None)] = "".join(f" xmlns:{p}={quoteattr(u)}" for p, u in prefixes.items())
    return ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + "".join(out)).encode()


def highlighted(content: bytes, marks: dict[int, str], parts: Iterable[tuple[int, int, int, str]] = ()) -> bytes:
    """A copy of the file without old shading and field codes, in which the paragraphs of ``marks`` and the
    ``parts`` (paragraph, begin and inclusive end in its normalised text, colour class) are shaded."""
    by: dict[int, list[tuple[int, int, str]]] = {k: [(0, 1 << 30, FILL[c])] for k, c in marks.items()}
    for k, begin, end, c in parts:
        by.setdefault(k, []).append((begin, end, FILL[c]))
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
        for item in z.infolist():
            data = z.read(item.filename)
            if item.filename == "word/document.xml" or item.filename.startswith(("word/header", "word/footer")):
                root = ET.fromstring(data)
                _without_codes(root, Fields())
                for props in root.iter(W + "rPr"):
                    for old in [*props.findall(W + "shd"), *props.findall(W + "highlight")]:
                        props.remove(old)
                body = root.find(W + "body")
                for k, p in enumerate(list(body.iter(W + "p")) if body is not None else ()):
                    if k in by:
                        _split(p, by[k])
                data = written(root, data)
            to.writestr(item, data)
    return out.getvalue()


def shaded(content: bytes) -> list[list[str | None]]:
    """For every paragraph, the fill of each character of its normalised text."""
    out = []
    for _, rs in paragraphs(content):
        fills: list[str | None] = []
        for r in rs:
            shd = next(r.element.iter(W + "shd"), None)
            fills += [shd.get(W + "fill") if shd is not None else None] * len(r.text)
        out.append(fills)
    return out


def agreeing(before: bytes, after: bytes, parts: Iterable[tuple[int, int, int, str]]) -> list[bool]:
    """For each part, whether a written copy still has its text, blanks aside, and shades all of it. Both files
    are parsed once, whatever the number of parts."""
    old, new = ([t for t, _ in paragraphs(x)] for x in (before, after))
    fills = shaded(after)
    same = lambda k, b, e: "".join(old[k][b : e + 1].split()) == "".join(new[k][b : e + 1].split())
    return [same(k, b, e) and all(fills[k][b : e + 1]) for k, b, e, _ in parts]


def agrees(before: bytes, after: bytes, part: tuple[int, int, int, str]) -> bool:
    return agreeing(before, after, [part])[0]


def copies(files: DataFrame, parts: DataFrame) -> DataFrame:
    """``files(path, content)`` with ``parts(path, line_no, from, to, colour)``, as ``locate.overlapping`` gives
    them -> ``(path, content, n_parts, n_agree, error)``, a row for each file that has parts."""
    one = F.struct("line_no", "from", "to", "colour")
    asked = files.select("path", "content").join(parts.groupBy("path").agg(F.sort_array(F.collect_list(one)).alias("parts")), "path")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content, asked in zip(*(c.to_pylist() for c in b.columns)):
                given = [(x["line_no"], x["from"], x["to"], x["colour"]) for x in asked]
                made, right, error = None, 0, None
                try:
                    made = highlighted(content, {}, given)
                    right = sum(agreeing(content, made, given))
                except Exception as e:  # a file's fault stays with the file
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pydict(
                    {"path": pa.array([path]), "content": pa.array([made], pa.binary()), "n_parts": pa.array([len(given)], pa.int32()), "n_agree": pa.array([right], pa.int32()), "error": pa.array([error], pa.string())}
                )

    return asked.mapInArrow(write, "path string, content binary, n_parts int, n_agree int, error string")
