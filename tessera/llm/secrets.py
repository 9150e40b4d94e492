"""Secret scans that also look inside encoded text.

Every text is scanned as it stands. Then a worklist unwraps what is encoded in it (percent escapes,
Unicode and character escapes, base64, and compressed data inside base64), layer by layer, until
nothing new comes out. Each layer is scanned again and its findings are mapped to the code points of
the original text that they came from. Escapes of escapes are unwrapped one level at a time for the
first levels, and by one linear pass down to their fixpoint, so depth costs neither time nor memory.
Decompression is a stream: what is larger than a window is scanned window by window.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns that findings are defined by, and the least lengths of what they match.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # as [0-9a-f]+ of 32 characters or more: runs are maximal
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

_WORDS = re.compile("passw|secret|token|api_?key", re.I | re.A)
_ESCAPED = re.compile(r"%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)")
_RUN = re.compile(r"\S+")
# The shortest finding has 14 characters ("token=" and eight more), which is 19 of base64; no shorter run can hold one.
_BASE64 = re.compile(r"([A-Za-z0-9+/_-]{16,})={0,2}")
_ALPHABETS = (re.compile(r"([A-Za-z0-9+/]{16,})={0,2}"), re.compile(r"([A-Za-z0-9_-]{16,})={0,2}"))
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
_PLAIN = str.maketrans("-_", "+/")
_PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00")

#: Levels of escapes that are unwrapped one by one; deeper ones at once.
LEVELS = 8
#: Bytes of decompressed data in a layer, bytes that the next one repeats, and bytes in all that a text's compressed
#: data may come to: beyond that (only compression bombs get there) the rest isn't unwrapped.
WINDOW, OVERLAP, MOST = 1 << 24, 1 << 16, 1 << 30

Span = tuple[int, int, int]  # start, kind, end: their order is the order of results


def scan(text: str) -> list[Span]:
    """The findings in a text as it stands."""
    found: list[Span] = []
    if _WORDS.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """For runs of a decoded text's characters, the code points of the original they stand for."""

    __slots__ = ("at", "pieces")

    def __init__(self, pieces: list[tuple[int, int, int, int, bool]]):
        #: Of each piece: its end here, the original's start and end, the characters here that share
        #: one unit there (0: all of the piece maps to all of the original), and if it was decoded.
        self.pieces, self.at = pieces, [p[0] for p in pieces]

    def origin(self, start: int, end: int) -> tuple[int, int, bool]:
        """The original's range for [start, end) and if any of it was decoded."""
        lo, hi, fresh = None, 0, False
        i = bisect_left(self.at, start + 1)
        while i < len(self.pieces):
            stop, a, b, step, decoded = self.pieces[i]
            begin = self.at[i - 1] if i else 0
            if begin >= end:
                break
            x, y = max(start, begin) - begin, min(end, stop) - begin
            if step == 1:
                a, b = a + x, a + y
            elif step == 3:  # base64: 3 bytes are 4 characters
                a, b = a + x // 3 * 4 + x % 3, min(b, a + (y - 1) // 3 * 4 + (y - 1) % 3 + 2)
            lo, hi, fresh = a if lo is None else min(lo, a), max(hi, b), fresh or decoded
            i += 1
        return (0 if lo is None else lo), hi, fresh


_ERRORS = (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError)
_STEP = 1 << 20  # bytes that a decompressor gives at once
_NESTED = 64  # streams directly inside one another


def _stream(head: bytes | memoryview, bare: bool):
    """A decompressor for data that begins with ``head``; None if nothing says so. ``bare``: else for deflate without a head."""
    if head[:3] == b"\x1f\x8b\x08":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 2 and not (head[0] * 256 + head[1]) % 31:
        return zlib.decompressobj()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return zlib.decompressobj(-15) if bare else None


def _decompressed(chunks: Iterator[bytes | memoryview], bare: bool, end: dict) -> Iterator[bytes]:
    """What the compressed members at the start of ``chunks`` hold, in chunks, as far as they go: a member that is cut
    off gives what there is. ``end`` gets ``left``, the bytes behind the last member, where that ended as it should."""
    kept, members = b"", 0
    while True:
        while len(kept) < 6 and (more := next(chunks, None)) is not None:
            kept = bytes(kept) + more if len(kept) else more
        stream = _stream(kept, bare and not members) if len(kept) else None
        if stream is None:
            if members:
                end["left"] = len(kept)
            return
        while not stream.eof:
            try:
                out = stream.decompress(kept, _STEP)
            except _ERRORS:
                return
            if out:
                yield out
            if stream.eof:
                break
            kept = getattr(stream, "unconsumed_tail", b"")
            hungry = stream.needs_input if hasattr(stream, "needs_input") else not kept and len(out) < _STEP
            if hungry:
                kept = next(chunks, None)
                if kept is None:
                    return
        kept = stream.unused_data
        members += 1


def _unpacked(raw: memoryview, bare: bool = False) -> tuple[Iterator[bytes], dict] | None:
    """The chunks of what is compressed at the start of ``raw``, streams inside streams undone as well, and the end of the
    outermost; None if nothing is."""
    end: dict = {}
    chunks = _decompressed(iter([raw]), bare, end)
    head = next(chunks, None)
    if head is None:
        return None
    for _ in range(_NESTED):
        while len(head) < 6 and (more := next(chunks, None)) is not None:
            head += more
        if _stream(head, False) is None:
            break
        inner = _decompressed(chain([head], chunks), False, {})
        first = next(inner, None)
        if first is None:
            break  # it only looked like that
        head, chunks = first, inner
    return chain([head], chunks), end


def _windows(chunks: Iterator[bytes], budget: list[int]) -> Iterator[bytes]:
    """Chunks joined to windows that overlap. ``budget``: bytes that may still come of all of a text's streams."""
    now = bytearray()
    for chunk in chunks:
        now += chunk
        budget[0] -= len(chunk)
        if budget[0] < 0:
            break
        if len(now) >= WINDOW:
            yield bytes(now)
            del now[:-OVERLAP]
    if now:
        yield bytes(now)


def _texts(raw: bytes) -> Iterator[str]:
    """Bytes as text; where they hold zero bytes, also without them, as that is what UTF-16 and UTF-32 add to ASCII."""
    yield _as_text(raw)
    if b"\0" in raw:
        yield _as_text(raw.replace(b"\0", b""))


def _as_text(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _decoded(text: str, pattern: re.Pattern, begin: int, end: int) -> tuple[str, list[tuple[int, int, int, bool]]]:
    """``text`` from ``begin`` to ``end`` with its escapes decoded, and pieces (length, start, end, decoded)."""
    out, pieces, at = [], [], begin
    for m in pattern.finditer(text, begin, end):
        if m.start() > at:
            out.append(text[at : m.start()])
            pieces.append((m.start() - at, at, m.start(), False))
        if m[0][0] == "%":
            raw = bytes.fromhex(m[0].replace("%", ""))
            k = 0
            while k < len(raw):  # one character at a time, for its own range
                n = 1 if raw[k] < 0x80 else 2 if raw[k] < 0xE0 else 3 if raw[k] < 0xF0 else 4
                try:
                    c = raw[k : k + n].decode("utf-8")
                except UnicodeDecodeError:
                    c, n = chr(raw[k]), 1
                out.append(c)
                pieces.append((len(c), m.start() + 3 * k, m.start() + 3 * min(len(raw), k + n), True))
                k += n
        else:
            code = int(m[0][3:-1], 16) if m[0][:3].lower() == "&#x" else int(m[0][2:-1]) if m[0][0] == "&" else int(m[0][2:], 16)
            c = chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"
            out.append(c)
            pieces.append((1, m.start(), m.end(), True))
        at = m.end()
    if at < end:
        out.append(text[at:end])
        pieces.append((end - at, at, end, False))
    return "".join(out), pieces


_HEX = frozenset("0123456789abcdefABCDEF")


def _last_escape(out: list[str]) -> tuple[int, str] | None:
    """The escape that ends with the last character: its length and what it stands for."""
    if out[-1] in _HEX:
        if len(out) > 2 and out[-3] == "%" and out[-2] in _HEX:
            return 3, chr(int(out[-2] + out[-1], 16))
        for mark, n in (("x", 2), ("u", 4), ("U", 8)):
            if len(out) > n + 1 and out[-n - 1] == mark and out[-n - 2] == "\\" and _HEX.issuperset(out[-n:]):
                code = int("".join(out[-n:]), 16)
                return n + 2, chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"
    elif out[-1] == ";":
        tail = "".join(out[-11:])
        at = tail.rfind("&#")
        if at >= 0 and (m := _UNICODE.fullmatch(tail, at)):
            code = int(m[0][3:-1], 16) if m[0][2] in "xX" else int(m[0][2:-1])
            return len(tail) - at, chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"
    return None


def _fixpoint(text: str, begin: int, end: int) -> tuple[str, list[tuple[int, int, int, bool]]]:
    """As ``_decoded``, for escapes of both kinds, again and again until none is left. Each step takes characters away, so
    one pass with a stack does it in linear time; bytes above 7F stay single characters."""
    out: list[str] = []
    low: list[int] = []
    high: list[int] = []
    for i in range(begin, end):
        out.append(text[i])
        low.append(i)
        high.append(i + 1)
        while (found := _last_escape(out)) is not None:
            n, c = found
            a, b = low[-n], high[-1]
            del out[-n:], low[-n:], high[-n:]
            out.append(c)
            low.append(a)
            high.append(b)
    pieces: list[tuple[int, int, int, bool]] = []
    i = 0
    while i < len(out):
        j = i + 1
        if high[i] - low[i] == 1:
            while j < len(out) and high[j] - low[j] == 1:
                j += 1
        pieces.append((j - i, low[i], high[j - 1], high[i] - low[i] > 1))
        i = j
    return "".join(out), pieces


def _unescaped(text: str, pattern: re.Pattern, deep: bool) -> Iterator[tuple[str, list[tuple[int, int, int, bool]]]]:
    """The whole text with its escapes decoded, as a match may go over spaces, and each run of non-space characters
    with an escape in it, as a match in the whole may begin before the run and take its key. ``deep``: where escapes are
    left, the same down to the fixpoint."""

    def both(begin: int, end: int):
        once = _decoded(text, pattern, begin, end)
        yield once
        if deep and (_PERCENT.search(once[0]) or _UNICODE.search(once[0])):
            yield _fixpoint(text, begin, end)

    first = pattern.search(text)
    if first:
        yield from both(0, len(text))
    while first:
        begin, end = first.start(), first.end()
        while begin and not text[begin - 1].isspace():
            begin -= 1
        end = m.end() if (m := _RUN.match(text, end)) else end
        yield from both(begin, end)
        first = pattern.search(text, end)


def _runs(text: str) -> Iterator[re.Match]:
    """What may be base64 (without its padding: group 1): runs over both alphabets; where a run mixes them, its runs over each."""
    for m in _BASE64.finditer(text):
        if ("+" in m[1] or "/" in m[1]) and ("-" in m[1] or "_" in m[1]):
            for alphabet in _ALPHABETS:
                yield from alphabet.finditer(text, m.start(), m.end())
        else:
            yield m


def _children(text: str, steps: int, budget: list[int]) -> Iterator[tuple[str, list[tuple[int, int, int, int, bool]], int]]:
    """The layers directly inside a text. Pieces refer to positions in that text. ``steps``: the levels of escapes that
    lie between the text and what it was unwrapped from by other means; each layer comes with its own."""
    for mark, pattern in (("%", _PERCENT), ("\\&", _UNICODE)):
        if steps < LEVELS and any(c in text for c in mark):
            for decoded, pieces in _unescaped(text, pattern, not steps):
                total, out = 0, []
                for n, a, b, fresh in pieces:
                    total += n
                    out.append((total, a, b, 0 if fresh else 1, fresh))
                yield decoded, out, steps + 1
    if "\n" in text:
        for m in _WRAPPED.finditer(text):
            lines = [(m.start() + x.start(), m.start() + x.end()) for x in re.finditer(r"\S+", m[0])]
            total, out = 0, []
            for a, b in lines:
                total += b - a
                out.append((total, a, b, 1, False))
            if total >= 16:
                yield "".join(text[a:b] for a, b in lines), out, steps
    for found in _runs(text):
        run = found[1].translate(_PLAIN)
        for skip in range(4):  # what comes before the encoded text may have any length
            n = len(run) - skip
            n -= n % 4 == 1
            raw = base64.b64decode(run[skip : skip + n] + "=" * (-n % 4))
            a, b = found.start() + skip, found.end()
            packed = False
            starts = [(m.start(), False) for m in _PACKED.finditer(raw)]
            if not any(at == 0 for at, _ in starts) and not raw.isascii():
                starts.append((0, True))
            for at, bare in starts:
                unpacked = _unpacked(memoryview(raw)[at:], bare)
                if unpacked is None:
                    continue
                windows = _windows(unpacked[0], budget)
                window, end = next(windows, None), unpacked[1]
                following = next(windows, None)
                if bare and (following is None and end.get("left") != 0):
                    continue  # deflate without a head says so by ending where the data end
                packed = packed or not at
                to = b if "left" not in end or not end["left"] else a - (-(len(raw) - end["left"]) * 4 // 3)
                while window is not None:
                    for decoded in _texts(window):
                        yield decoded, [(len(decoded), a + at // 3 * 4, to, 0, True)], 0
                    window, following = following, next(windows, None) if following is not None else None
            if not packed:
                for decoded in _texts(raw):
                    yield decoded, [(len(decoded), a, b, 3 if len(decoded) == len(raw) else 0, True)], 0


def deep_scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """The findings as the text stands, and all findings: those and what its layers hold.

    A layer that was met before for the same range of the original is not unwrapped again, so cycles
    end; each other layer is shorter than what it came from, or comes from decompression, which is cut
    into windows and ends for good after MOST bytes of a text. Escapes of escapes give a layer for each of the first
    LEVELS levels and one for their fixpoint.
    """
    text = text or ""
    base = scan(text)
    spans = set(base)
    work: deque[tuple[str, list[Layer], int]] = deque([(text, [], 0)])
    seen: set[tuple[bytes, int, int]] = set()
    budget = [MOST]
    while work:
        now, above, steps = work.popleft()
        for decoded, pieces, depth in _children(now, steps, budget):
            layer = Layer(pieces)
            layers = [*above, layer]
            a, b = 0, len(decoded)
            for up in reversed(layers):
                a, b, _ = up.origin(a, b)
            key = (hashlib.blake2b(decoded.encode("utf-8", "surrogatepass"), digest_size=16).digest(), a, b)
            if key in seen or decoded == now:
                continue
            seen.add(key)
            for start, kind, end in scan(decoded):
                x, y, fresh = layer.origin(start, end)
                if fresh:  # else the layer above has it as well
                    for up in reversed(above):
                        x, y, _ = up.origin(x, y)
                    spans.add((x, kind, y))
            work.append((decoded, layers, depth))
    return base, sorted(spans)


def render(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_RESULT = "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and a digest of the findings as the text stands, and the spans of all findings.

    Null and empty texts have no findings; null ids stay null; repeated rows give repeated results; an
    empty table gives an empty result; other columns are not read. Whole texts are scanned, each in the
    task that reads it, at any depth of nesting; compression bombs are scanned in windows up to MOST bytes.
    """
    schema = pa.schema([("id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, spans = deep_scan(text.as_py())
                rows.append((*(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(render(base).encode()).hexdigest(), render(spans)))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:]))], schema=schema)

    return docs.selectExpr(f"cast(`{id_col}` as long) id", f"cast(`{text_col}` as string) text").mapInArrow(run, _RESULT)


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with each range of overlapping or adjoining findings replaced by ``mark``."""
    if not text:
        return text
    _, spans = deep_scan(text)
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        a, _, b = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] <= b:
            i += 1
            b = max(b, spans[i][2])
        out += [text[at:a], mark]
        at, i = b, i + 1
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with the secrets in the text replaced.

    Null and empty texts stay as they are; repeated rows stay repeated; an empty table stays empty; columns of any
    name stay.
    """

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(redact, na_action="ignore")

    return docs.withColumn(text_col, clean(F.col(f"`{text_col}`")))
