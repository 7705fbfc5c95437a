"""Secret scan: a worklist of decoded layers, each scanned, its spans mapped to the text they come from.

A layer is unwrapped by undoing URL escapes, Unicode escapes and character numbers, base64 runs, also those wrapped over lines,
and gzip, zlib, bzip2 and zstandard streams within base64, all members of them, to any depth. Of bytes that are no text the
printable stretches are scanned, in UTF-16 too. Each new layer joins the worklist until nothing new turns up. A layer whose text and place were
seen before ends a cycle. Escapes map back character by character; a base64 run maps back as a whole. A run is decoded from each of
its first four characters, as a word or a path may stand before it without a break.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import re
import zlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, texts_of

#: Kinds, in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = ("passw", "secret", "token", "apikey", "api_key")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
_ONE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\[uUx]([0-9A-Fa-f]+)|&#([0-9]+);|&#[xX]([0-9A-Fa-f]+);")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Runs that only line ends and indentation part.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
#: The shortest secret has 12 characters, all of them ASCII.
_PRINTABLE = re.compile(rb"[\t\n\r\x20-\x7e]{12,}")
_UTF16 = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){12,}|(?:\x00[\t\n\r\x20-\x7e]){12,}")
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\x28\xb5\x2f\xfd")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of each secret that stands openly in a text; code points, end exclusive."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return found


def _character(m: re.Match) -> str | None:
    code = int(m[3]) if m[3] else int(m[1] or m[2] or m[4], 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _surrogates(m: re.Match) -> list[tuple[str, int, int]]:
    """(character, start, end) within an escape run; surrogate pairs become one character, what is no character stays as it is."""
    out, ones = [], list(_ONE.finditer(m[0]))
    k = 0
    while k < len(ones):
        one = ones[k]
        high = int(one[2], 16) if one[2] and len(one[2]) == 4 else 0
        if 0xD800 <= high < 0xDC00 and k + 1 < len(ones) and ones[k + 1][2] and 0xDC00 <= (low := int(ones[k + 1][2], 16)) < 0xE000:
            out.append((chr(0x10000 + (high - 0xD800 << 10) + low - 0xDC00), one.start(), ones[k + 1].end()))
            k += 2
            continue
        c = _character(one)
        out += [(c, one.start(), one.end())] if c is not None else [(x, one.start() + i, one.start() + i + 1) for i, x in enumerate(one[0])]
        k += 1
    return out


def _percents(m: re.Match) -> list[tuple[str, int, int]]:
    """(character, start, end) within a run of URL escapes; bytes that are no UTF-8 stay escaped."""
    raw, out, at = bytes.fromhex(m[0].replace("%", "")), [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append((raw[at : at + n].decode(), 3 * at, 3 * (at + n)))
            except UnicodeDecodeError:
                continue
            break
        else:
            n = 1
            out += [(m[0][3 * at + i], 3 * at + i, 3 * at + i + 1) for i in range(3)]
        at += n
    return out


class Layer:
    """A text and where its stretches come from in the layer that it was found in, ``up``; None for a text itself.

    ``at`` are the stretches' first characters, ``to`` what each comes from: (start, end, whether character by character).
    """

    __slots__ = ("text", "up", "at", "to", "depth")

    def __init__(self, text: str, up: Layer | None = None, at: list[int] | None = None, to: list[tuple[int, int, bool]] | None = None):
        self.text, self.up, self.at, self.to, self.depth = text, up, at, to, up.depth + 1 if up else 0

    def span(self, a: int, b: int) -> tuple[int, int]:
        """Where the characters from a to b come from in the original text."""
        layer = self
        while layer.up:
            i, j = bisect_right(layer.at, a) - 1, bisect_right(layer.at, b - 1) - 1
            a = layer.to[i][0] + (a - layer.at[i] if layer.to[i][2] else 0)
            b = layer.to[j][0] + b - layer.at[j] if layer.to[j][2] else layer.to[j][1]
            layer = layer.up
        return a, b


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with each match decoded; None if that changes nothing."""
    text, parts, at, to = layer.text, [], [], []
    size = last = 0
    changed = False
    for m in pattern.finditer(text):
        got = decode(m)
        plain = "".join(c for c, _, _ in got)
        changed |= plain != m[0]
        if m.start() > last:
            at.append(size)
            to.append((last, m.start(), True))
            size += m.start() - last
        for c, x, y in got:
            at.append(size)
            to.append((m.start() + x, m.start() + y, False))
            size += len(c)
        parts += [text[last : m.start()], plain]
        last = m.end()
    if not changed:
        return None
    at.append(size)
    to.append((last, len(text), True))
    return Layer("".join(parts) + text[last:], layer, at, to)


def _opener(data: bytes, at: int):
    """A decompressor for the stream that starts at a place, and how many bytes to hand it at once; None if none starts there."""
    head = data[at : at + 4]
    if head[:3] == b"\x1f\x8b\x08" or len(head) > 2 and head[0] & 15 == 8 and (head[0] << 8 | head[1]) % 31 == 0:
        return zlib.decompressobj(47), 1 << 14
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor(), 1 << 14
    if head == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj(), 256  # has no bound for its output; a block of 4 bytes gives 128 KiB
    return None


def _inflated(data: bytes, at: int, most: int) -> tuple[bytes, int]:
    """What the streams from a place on hold, members end to end, as far as they are whole, and where they end; ``at`` if none starts there.

    Raises OverflowError beyond ``most`` bytes.
    """
    parts, total = [], 0
    while opened := _opener(data, at):
        d, step = opened
        pos = at
        while pos < len(data) and not d.eof:
            piece = data[pos : pos + step]
            try:
                out = d.decompress(piece) if step == 256 else d.decompress(piece, most + 1 - total)
            except (zlib.error, OSError, EOFError, ValueError):
                return b"".join(parts), at
            except Exception as e:  # zstandard's own error has no public base class but Exception
                if type(e).__name__ != "ZstdError":
                    raise
                return b"".join(parts), at
            parts.append(out)
            if (total := total + len(out)) > most:
                raise OverflowError
            pos += len(piece) - len(d.unused_data)
        at = pos
        if not d.eof:
            break
    return b"".join(parts), at


def _plain(data: bytes) -> list[str]:
    """The text that bytes are, or else their printable stretches, of one byte a character and of UTF-16."""
    try:
        if not _CONTROL.search(text := data.decode()):
            return [text]
    except UnicodeDecodeError:
        pass
    found = [m[0].decode() for m in _PRINTABLE.finditer(data)]
    return found + [m[0].replace(b"\0", b"").decode() for m in _UTF16.finditer(data)]


def _opened(data: bytes, most: int) -> tuple[list[str], int]:
    """The texts in bytes and in the streams in them, to any depth; how many streams were too large."""
    texts, large = [], 0
    work, seen = [data], set()
    while work:
        data = work.pop()
        key = hashlib.blake2b(data, digest_size=16).digest()
        if key in seen:
            continue
        seen.add(key)
        texts += _plain(data)
        at = 0
        while at < len(data):
            try:
                inner, end = _inflated(data, at, most)
            except OverflowError:
                inner, end = b"", at
                large += 1
            if inner:
                work.append(inner)
            # a zlib header is too weak to be looked for; it counts at the start only, and where another stream has ended
            m = _MAGIC.search(data, max(end, at + 1))
            at = m.start() if m else len(data)
    return texts, large


def _joined(text: str):
    """(start, end, base64 characters) of each run, and of runs wrapped over lines.

    Wrapped lines are of one width but for the last, which may be shorter, and the first, which may start within a line. Of lines
    that only line ends part, each block of one width is joined, with and without the line before, and all of them together.
    """
    for m in _BASE64.finditer(text):
        yield m.start(), m.end(), m[0]
    for m in _WRAPPED.finditer(text):
        lines = [(x.start(), x.end()) for x in _LINE.finditer(text, m.start(), m.end())]
        ranges = {(0, len(lines))}
        first = 0
        while first < len(lines):
            last = first
            width = lines[first][1] - lines[first][0]
            while last < len(lines) and lines[last][1] - lines[last][0] == width:
                last += 1
            over = last + (last < len(lines) and lines[last][1] - lines[last][0] < width)
            ranges |= {(a, over) for a in (first, max(0, first - 1)) if over - a > 1}
            first = last
        for a, b in ranges:
            body = "".join(text[x:y] for x, y in lines[a:b])
            if len(body) >= 16:
                yield lines[a][0], m.end() if b == len(lines) else lines[b - 1][1], body


def _runs(layer: Layer, most: int) -> tuple[list[Layer], int]:
    """The layers that base64 runs hold, plain or compressed; how many streams were too large."""
    out, large = [], 0
    for start, end, run in _joined(layer.text):
        body = run.rstrip("=").replace("-", "+").replace("_", "/")
        for shift in range(4):
            left = body[shift:]
            left = left[: len(left) - (len(left) % 4 == 1)]  # one character alone holds no byte
            texts, more = _opened(base64.b64decode(left + "=" * (-len(left) % 4)), most)
            large += more
            out += [Layer(x, layer, [0], [(start, end, False)]) for x in texts if x]
    return out, large


def scan(text: str, most: int = 1 << 26) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]], int]:
    """Open secrets; all secrets as (start, kind, end, depth); layers left folded as they would hold over ``most`` bytes."""
    base = sorted(set(detect(text)))
    spans = {x: 0 for x in base}
    work = [Layer(text)]
    seen: set[bytes] = set()
    folded = 0
    while work:
        layer = work.pop()
        if layer.depth:
            for a, kind, b in detect(layer.text):
                start, end = layer.span(a, b)
                spans.setdefault((start, kind, end), layer.depth)
        inner, large = _runs(layer, most)
        folded += large
        if "%" in layer.text:
            inner.append(_replaced(layer, _PERCENT, _percents))
        if "\\" in layer.text or "&#" in layer.text:
            inner.append(_replaced(layer, _ESCAPE, _surrogates))
        for found in inner:
            if found is None or not found.text:
                continue
            key = hashlib.blake2b(f"{found.span(0, len(found.text))}{found.text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
            if key not in seen:
                seen.add(key)
                work.append(found)
    return base, sorted((a, k, b, d) for (a, k, b), d in spans.items()), folded


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32())])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_layer_bytes: int = 1 << 26) -> DataFrame:
    """Secrets of each row's whole text: doc_id, spans (kind, start, end, depth), n_folded.

    ``depth`` 0 marks secrets that stand openly, others the number of layers around them; spans are in order of start, then
    kind. A null or empty text has none. Rows that repeat an id each give a row; an empty table gives none; other columns are
    not read. A compressed layer of more than ``most_layer_bytes`` bytes (a decompression bomb) is not opened but counted in
    ``n_folded``. Each row is scanned by itself, so nothing is shuffled.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(_SPAN)), ("n_folded", pa.int64())])

    def rows_of(batch):
        for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch, 1)):
            _, spans, folded = scan(text, most_layer_bytes)
            yield doc_id, [{"kind": KINDS[k], "start": a, "end": b, "depth": d} for a, k, b, d in spans], folded

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda batches: arrow_rows(batches, rows_of, schema), "doc_id long, spans array<struct<kind:string,start:long,end:long,depth:int>>, n_folded long")


def secret_digests(docs: DataFrame) -> DataFrame:
    """The contract's columns, from the operator's spans."""
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    base = F.filter("spans", lambda x: x.depth == 0)
    count = lambda kind: F.size(F.filter("spans", lambda x: (x.depth == 0) & (x.kind == kind))).cast("long").alias(f"n_{kind}")
    return scan_secrets(docs).select("doc_id", *(count(k) for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "n_folded")
