"""Secret scan with a worklist of decoded layers."""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame

from .common import guarded, restored, texts

KINDS = ("assign", "access", "hex")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Runs that line breaks cut, which may be written as escapes and be followed by an indent or quote marks.
_BREAK = r"(?:\r\n|\r|\n|\\r\\n|\\n)[ \t>]*"
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:{_BREAK}[A-Za-z0-9+/_-]++)++={{0,2}}")
_BREAKS = re.compile(_BREAK)
#: How base64 of compressed data starts: gzip, zlib at its four levels, bzip2 and xz.
_PACKED64 = re.compile(r"H4sI|eA[E-H]|eF[4-7]|eJ[w-z]|eN[o-r]|Qlpo[MNOQRS]|/Td6WFoA")
#: Stretches of decoded bytes that can hold a match or a further layer: both are ASCII, and no match has fewer characters.
_CLEAN = re.compile(rb"[\t\n\r\x20-\x7e]{12,}")
#: First bytes of gzip, zlib, bzip2 and xz data.
_PACKED = (b"\x1f\x8b", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda", b"BZh", b"\xfd7zXZ\x00")

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind's number, end) of each kind's leftmost non-overlapping matches, by start and kind."""
    found: list[Span] = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a run of hexadecimal digits is one match whole, so the shorter runs need not be tried
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A decoded text and, for each of its characters, where it comes from in the document (None: the document itself)."""

    def __init__(self, text: str, starts: array | None = None, ends: array | None = None, whole: tuple[int, int] | None = None, cut: bool = False, sure: bool = True):
        self.text, self.starts, self.ends = text, starts, ends
        # the one place that all characters come from; whether text stands before this one; whether it is no guess
        self.whole, self.cut, self.sure = whole, cut, sure

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.whole is not None:
            return self.whole
        return (start, end) if self.starts is None else (min(self.starts[start:end]), max(self.ends[start:end]))

    def replaced(self, parts: list[tuple[int, int, str, list[tuple[int, int]]]]) -> Layer:
        """This layer with stretches (start, end, text, source of each character) put in."""
        if self.whole is not None:
            text, at = [], 0
            for s, e, new, _ in parts:
                text += [self.text[at:s], new]
                at = e
            return Layer("".join([*text, self.text[at:]]), whole=self.whole, cut=self.cut, sure=self.sure)
        text, starts, ends, at = [], array("q"), array("q"), 0
        own_s = self.starts if self.starts is not None else range(len(self.text))
        own_e = self.ends if self.ends is not None else range(1, len(self.text) + 1)
        for s, e, new, sources in [*parts, (len(self.text), len(self.text), "", [])]:
            text.append(self.text[at:s])
            starts.extend(own_s[at:s])
            ends.extend(own_e[at:s])
            text.append(new)
            for a, b in sources:
                x, y = self.origin(a, b)
                starts.append(x)
                ends.append(y)
            at = e
        return Layer("".join(text), starts, ends)

    def isolated(self, start: int, end: int, text: str, cut: bool = False, sure: bool = True) -> Layer:
        """A text decoded from a whole stretch: each character comes from all of it."""
        return Layer(text, whole=self.origin(start, end), cut=cut, sure=sure)


_LONE_BYTE, _LONE_HALF = re.compile("[\udc80-\udcff]"), re.compile("[\ud800-\udfff]")


def _url(layer: Layer) -> Iterator[Layer]:
    if "%" not in layer.text:
        return
    parts = []
    for m in _PERCENT.finditer(layer.text):
        raw = bytes.fromhex(m[0].replace("%", ""))
        new, at, sources = raw.decode(errors="surrogateescape"), m.start(), []
        for c in new:
            n = 3 * len(c.encode(errors="surrogateescape"))
            sources.append((at, at + n))
            at += n
        new = _LONE_BYTE.sub(lambda x: chr(ord(x[0]) - 0xDC00), new)  # a byte that is no UTF-8 stands for itself
        parts.append((m.start(), m.end(), new, sources))
    if parts:
        yield layer.replaced(parts)


def _unicode(layer: Layer) -> Iterator[Layer]:
    if "\\" not in layer.text and "&#" not in layer.text:
        return
    parts = []
    for m in _ESCAPE.finditer(layer.text):
        x, sources, at = m[0], [], m.start()
        try:
            if x.startswith("&#"):
                new = chr(int(x[3:-1], 16) if x[2] in "xX" else int(x[2:-1]))
            elif x.startswith("\\u{"):
                new = chr(int(x[3:-1], 16))
            elif x.startswith("\\u"):
                new = _LONE_HALF.sub("�", bytes.fromhex(x.replace("\\u", "")).decode("utf-16-be", "surrogatepass"))
            else:
                new = chr(int(x[2:], 16))
            new.encode()
        except (ValueError, OverflowError):
            continue
        if x.startswith("\\u") and x[2] != "{":
            for c in new:
                n = 6 if c <= "￿" else 12
                sources.append((at, at + n))
                at += n
        else:
            sources = [(m.start(), m.end())]
        parts.append((m.start(), m.end(), new, sources))
    if parts:
        yield layer.replaced(parts)


def _decompressor(head: bytes):
    if head.startswith(b"BZh"):
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if head.startswith(b"\xfd7zXZ\x00") else zlib.decompressobj(47)


def _unpacked(chunks: Iterator[bytes], step: int = 1 << 20) -> Iterator[bytes]:
    """What compressed data holds, member after member, in pieces of at most `step`; as far as it can be read, and what follows it."""
    data = next(chunks, b"")
    try:
        while data.startswith(_PACKED):
            own, done = _decompressor(data), False
            while not done:
                out = own.decompress(data, step)
                if out:
                    yield out
                done = own.eof
                if isinstance(own, (bz2.BZ2Decompressor, lzma.LZMADecompressor)):
                    data = b"" if done or not own.needs_input else next(chunks, None)
                else:
                    data = own.unconsumed_tail or (b"" if done or len(out) == step else next(chunks, None))
                if data is None:
                    return
            data = own.unused_data
            while len(data) < 6 and (more := next(chunks, None)) is not None:
                data += more
    except (OSError, ValueError, EOFError, zlib.error, lzma.LZMAError):
        return
    if data:
        yield data
    yield from chunks


def _taken(chunks: Iterator[bytes], most: int) -> bytes:
    """The next bytes, at least `most` if there are so many."""
    got, n = [], 0
    while n < most and (x := next(chunks, None)) is not None:
        got.append(x)
        n += len(x)
    return b"".join(got)


def _unfolded(data: bytes, window: int, chunks: Iterator[bytes] = iter(())) -> Iterator[tuple[str, bool]]:
    """(text, whether it is UTF-8): decoded data and the chunks after it, unpacked as often as it is packed, in windows of about `window` bytes, each half over the one before.

    UTF-8 where it is such, else Latin-1: any byte is a character, so nothing is thrown away.
    """
    head, seen = data, set()
    while head.startswith(_PACKED) and (h := hashlib.blake2b(head).digest()) not in seen:
        seen.add(h)
        inner = _unpacked(chain([head], chunks))
        if not (first := _taken(inner, window)):
            break
        head, chunks = first, inner
    while True:
        more = next(chunks, b"")
        end = len(head)
        while more and end > len(head) - 3 and head[end - 1] & 0xC0 == 0x80:
            end -= 1
        end -= bool(more and head[end - 1] >= 0xC0)
        text = head[:end]
        try:
            yield text.decode(), True
        except UnicodeDecodeError:
            yield text.decode("latin-1"), False
        if not more:
            return
        at = end - min(end, window // 2)
        while at < end and head[at] & 0xC0 == 0x80:
            at += 1
        head = head[at:] + more
        head += _taken(chunks, window - len(head))


def _decoded(body: str) -> bytes:
    """Base64 of either alphabet, as far as it has whole bytes."""
    body = body.replace("-", "+").replace("_", "/")
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _blocks(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """(first, end) of the blocks of lines of one length with a last one that is no longer, as encoders write them."""
    i = 0
    while i < len(lengths):
        j = i + 1
        while j < len(lengths) and lengths[j] == lengths[i]:
            j += 1
        end = j + 1 if j < len(lengths) and lengths[j] < lengths[i] else j
        if end - i > 1:
            yield i, end
        i = j


class Run:
    """Characters of base64, with the line breaks inside them left out, and where they stand in the text."""

    def __init__(self, text: str, start: int, end: int):
        self.start, self.end, self.at, self.places, lines, at = start, end, [], [], [], start
        for x in [*((m.start(), m.end()) for m in _BREAKS.finditer(text, start, end)), (end, end)]:
            self.at.append(sum(map(len, lines[-1:])) + (self.at[-1] if self.at else 0))
            self.places.append(at)
            lines.append(text[at : x[0]])
            at = x[1]
        lines[-1] = lines[-1].rstrip("=")
        self.lines, self.body = lines, "".join(lines)

    def place(self, i: int) -> int:
        """Where character i of the body stands; the end of the run for what lies behind it."""
        if i >= len(self.body):
            return self.end
        k = bisect_right(self.at, i) - 1
        return self.places[k] + i - self.at[k]

    def after(self, i: int) -> int:
        return self.end if i >= len(self.body) else self.place(i - 1) + 1


class Members:
    """What the compressed data whose base64 starts at a place holds, decoded piece by piece; taken: the characters that whole members fill."""

    STEP = 1 << 12

    def __init__(self, body: str, at: int):
        self.body, self.at, self.taken = body, at, 0

    def __iter__(self) -> Iterator[bytes]:
        pieces = (_decoded(self.body[i : i + self.STEP]) for i in range(self.at, len(self.body), self.STEP))
        data, read = next(pieces, b""), 0
        try:
            while data.startswith(_PACKED):
                own = _decompressor(data)
                if isinstance(own, bz2.BZ2Decompressor) and data[4:10] != b"1AY&SY":
                    return
                while not own.eof:
                    if out := own.decompress(data, 1 << 20):
                        yield out
                    left = getattr(own, "unconsumed_tail", b"")
                    read, data = read + len(data) - len(left), left
                    if not own.eof and not data and (isinstance(own, type(zlib.decompressobj())) or own.needs_input):
                        if not (data := next(pieces, b"")):
                            return
                read, data = read - len(own.unused_data), own.unused_data
                self.taken = read // 3 * 4
                while len(data) < 10 and (more := next(pieces, b"")):
                    data += more
        except (OSError, ValueError, EOFError, zlib.error, lzma.LZMAError):
            return


def _base64(layer: Layer, window: int) -> Iterator[Layer]:
    """What base64 in the text holds, wherever in a run of its characters it starts.

    Names and paths put letters, dashes and slashes right before it. So a run is decoded
    whole, then from its second, third and fourth character on, of which the stretches
    of plain characters are kept, each at its own place; then from each place where
    packed data starts, past which the search goes on. A run that lines cut is read
    as one, and so is each block of lines as encoders write them. All of that takes time
    in proportion to the text.
    """
    found = [(m.start(), m.end()) for m in _BASE64.finditer(layer.text)]
    lone = len(found)
    found += [(m.start(), m.end()) for m in _WRAPPED.finditer(layer.text)]
    for number, (start, stop) in enumerate(found):
        run = Run(layer.text, start, stop)
        for i, end in [(0, len(run.lines)), *(_blocks([*map(len, run.lines)]) if number >= lone else ())]:
            body = run.body if end - i == len(run.lines) else "".join(run.lines[i:end])
            if len(body) < 16 or (i == 0 and end == len(run.lines) and body is not run.body):
                continue
            last = run.end if end == len(run.lines) else run.places[end - 1] + len(run.lines[end - 1])
            for k, (new, sure) in enumerate(_unfolded(_decoded(body), window)):
                yield layer.isolated(run.places[i], last, new, k > 0, sure)
        if len(run.body) < 16:
            continue
        for skip in (1, 2, 3):
            for m in _CLEAN.finditer(_decoded(run.body[skip:])):
                a, b = skip + m.start() // 3 * 4, skip - -m.end() // 3 * 4
                yield layer.isolated(run.place(a), run.after(b), m[0].decode())
        at = 1
        while (m := _PACKED64.search(run.body, at)) is not None:
            at = m.start() + 1
            inner = Members(run.body, m.start())
            chunks = iter(inner)
            if first := next(chunks, b""):
                for k, (new, sure) in enumerate(_unfolded(first, window, chunks)):
                    yield layer.isolated(run.place(m.start()), run.end, new, k > 0, sure)
                at += max(inner.taken - 1, 0)


def _is_text(text: str) -> bool:
    return text.isprintable() or all(c.isprintable() or c in "\t\n\r" for c in text)


def scan(text: str, limit: int = 1 << 26) -> tuple[list[Span], list[Span], int]:
    """(base spans, all spans, layers): the worklist runs until no layer gives a text not seen before.

    A layer is unwrapped in each way that it can be, and each new text is scanned
    again, printable or not; the layers counted are those of printable UTF-8 or with a
    match. A text seen before at the same place is left out, so cycles end. What
    compressed data unfolds to is scanned whole, in windows of about `limit` bytes that
    overlap by half. Where that is more than `limit`, a packed stretch inside it of over
    half of `limit` can fall across two windows.
    """
    base = base_spans(text)
    spans, seen, layers = set(base), {_name(Layer(text))}, 0
    under = lambda x: chain(_url(x), _unicode(x), _base64(x, limit))
    work = [under(Layer(text))]
    while work:
        if (new := next(work[-1], None)) is None:
            work.pop()
            continue
        if not new.text or (key := _name(new)) in seen:
            continue
        seen.add(key)
        found = base_spans(new.text)
        layers += bool(found) or (new.sure and _is_text(new.text))
        for s, k, e in found:
            a, b = new.origin(s, e)
            spans.add((a, k, b))
        work.append(under(new))
    return base, sorted(spans), layers


def _name(layer: Layer) -> tuple[bytes, tuple[int, int]]:
    return hashlib.blake2b(layer.text.encode(errors="surrogatepass"), digest_size=16).digest(), layer.origin(0, len(layer.text)) if layer.text else (0, 0)


def written_spans(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_layers) for each row.

    Counts and base_sha256 are of the undecoded text; spans holds those and the ones
    found in decoded layers, as places in the document, in code points. Null texts
    count as empty, which have no spans; texts are scanned whole; repeated rows are
    scanned each; null ids stay null; an empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [scan(t) for t in b["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": b["doc_id"],
                    "no_id": b["no_id"],
                    **{f"n_{name}": [sum(s[1] == k for s in f[0]) for f in found] for k, name in enumerate(KINDS)},
                    "base_sha256": [hashlib.sha256(written_spans(f[0]).encode()).hexdigest() for f in found],
                    "spans": [written_spans(f[1]) for f in found],
                    "n_layers": [f[2] for f in found],
                }
            )

    kinds = "doc_id long, no_id boolean, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long"
    return restored(guarded(texts(docs, id_col, text_col)).mapInPandas(run, kinds))
