"""Secret scan with a worklist of decoded layers.

The whole text is scanned; then every layer that can be unwrapped from it (URL
escapes, Unicode and character-reference escapes, base64 of either alphabet,
zlib or gzip under base64, with all members and whatever is compressed inside
them) goes onto a worklist, is scanned in turn and unwrapped further, until no
new layer appears. A layer that was seen before (same characters at the same
place) is not visited again, so cycles end. Each character of a layer knows the
code points of the original text that it came from, and so every finding is
reported as a span of the original text.

A run of base64 may hold a path or a name before the encoded part, so it is read
from its start and from behind each of + / - _. Bytes that are not clean UTF-8
are read byte by byte (latin-1), and their stretches of UTF-16 as such; a finding
of such a rough reading yields to one of a clean reading at the same place.

Kinds, in the order that breaks ties: assign (a name such as password followed
by a value of six characters or more; the span covers the whole match), access
(AKIA and upper-case letters or digits, 20 in all), hex (24 lower-case digits).

Defined cases. Null text counts as empty: no spans, and base_sha256 is the
digest of the empty string. Repeated rows give repeated answers; an empty table
gives an empty result; other columns are not read. Texts are never cut.
Compressed content, whatever its size, is inflated and looked at in windows of 1 MB
that end at white space (or share 64 KB where there is none), so memory stays
bounded; only a finding or base64 run that is longer than what two windows share,
without any white space, may be seen in parts. Equal windows at one place are
looked at once, and content that begins as one that holds it is not unwrapped again.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import zlib
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from panelforge.llm.common import mapped, slices, table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?((?-i:[A-Za-z0-9+/_.=-]+))""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs: the same spans as [0-9a-f]+ with a later length test
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
URL_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9a-fA-F]{4})+|\\U[0-9a-fA-F]{8}|\\x[0-9a-fA-F]{2}|&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};")
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: A run that goes on over line breaks, as MIME and PEM wrap it.
WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[A-Za-z0-9+/_-]{16,})*\r?\n[A-Za-z0-9+/_-]{2,}={0,2}|[A-Za-z0-9+/_-]{16,}(?:\r?\n[A-Za-z0-9+/_-]{16,})+={1,2}")
PARTS = tuple(re.compile(f"[A-Za-z0-9{x}]{{16,}}") for x in ("+/", "_-", "+_-"))  # of a run: one alphabet, or between slashes
BEHIND = re.compile(r"[+/_-]")
#: What may start a gzip or zlib stream, at the start of a run or behind a sign.
PACKED = re.compile(r"(?<![A-Za-z0-9])(?:H4sI|[CGKOSWae][A-P])")
STANDARD = str.maketrans("-_", "+/")
GZIP = b"\x1f\x8b\x08"
#: Bytes of compressed content that are looked at together, that two windows share at most, and that one step inflates.
WINDOW, OVERLAP, PIECE = 1 << 20, 1 << 16, 1 << 18
#: Bytes without any of these hold neither a finding nor a further layer.
WORTH = re.compile(rb"passw|secret|token|api_?key|AKIA|[A-Za-z0-9+/_-]{16}|%[0-9a-f]{2}|\\[ux]|&#", re.I)
WIDE = re.compile(rb"(?:[\t-\r -~]\x00){8,}[\t-\r -~]?")  # UTF-16 of either byte order


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of all findings in ``text`` as it stands, end exclusive, sorted."""
    found = []
    folded = text.encode("utf-8", "surrogatepass").lower()
    if any(n in folded for n in NAMES):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


class Layer:
    """Decoded characters and, for each, the first and last-plus-one code point of the original text."""

    __slots__ = ("text", "starts", "ends", "rough")

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray, rough: bool = False):
        self.text, self.starts, self.ends, self.rough = text, starts, ends, rough

    def key(self) -> bytes:
        place = b"%d:%d:%d:" % (self.rough, self.starts[0], self.ends[-1]) if len(self.text) else b""
        return hashlib.blake2b(place + self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _printable(raw: bytes) -> str | None:
    """The text of ``raw`` if it is UTF-8 without control characters, else None."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text and not re.search(r"[\x00-\x08\x0e-\x1f\x7f]", text) else None


def _packed(raw: bytes, at: int) -> bool:
    """Whether a gzip or zlib header stands at ``at``."""
    return raw[at : at + 3] == GZIP or (len(raw) > at + 1 and raw[at] & 0x8F == 8 and (raw[at] << 8 | raw[at + 1]) % 31 == 0)


def _inflated(raw: bytes, at: int, sink=None) -> tuple[int, bool, bool]:
    """(end, whether it is whole, whether it holds anything) of the stream at ``at``, up to the first damaged byte; its
    content goes to ``sink`` in pieces of bounded size. Read in growing steps, so that a short stream costs little
    before a long rest."""
    d, step, any_ = zlib.decompressobj(47), 256, False
    while at < len(raw) and not d.eof:
        before, piece = d.copy(), raw[at : at + step]
        try:
            out = [d.decompress(piece, PIECE)]
        except zlib.error:
            try:
                out = []
                for k in range(len(piece)):
                    out.append(before.decompress(piece[k : k + 1]))
            except zlib.error:
                pass
            if sink:
                for x in out:
                    sink(x)
            return at + k, False, any_ or any(out)
        any_ = any_ or bool(out[0])
        if sink:
            sink(out[0])
        at += len(piece) - len(d.unused_data) - len(d.unconsumed_tail)
        step = min(2 * step, 1 << 16)
    while not d.eof and (rest := d.decompress(b"", PIECE)):
        any_ = True
        if sink:
            sink(rest)
    return at, d.eof, any_


class _Content:
    """The content of one stream, taken in pieces: windows of it go to ``visit``, and what is compressed inside it to
    contents of its own. Windows end at white space where there is some, else they overlap, so that a finding is whole
    in one of them. A content that begins as one that it came out of does is not unwrapped again."""

    def __init__(self, visit, above: tuple[bytes, ...] = ()):
        self.visit, self.above, self.window, self.inner, self.fed, self.over = visit, above, bytearray(), None, 0, False

    def write(self, piece: bytes) -> None:
        if not self.over:
            self.window += piece
            while len(self.window) >= WINDOW:
                self._cut(False)

    def close(self) -> None:
        if self.window and not self.over:
            self._cut(True)
        if self.inner:
            self.inner.close()

    def _cut(self, last: bool) -> None:
        body = bytes(self.window[:WINDOW])
        if self.inner is None:
            own = hashlib.blake2b(body, digest_size=16).digest()
            if own in self.above:
                self.over = True
                return
            self.inner = _Unwrapped(lambda: _Content(self.visit, (*self.above, own)))
        self.inner.write(body[self.fed :])
        end = len(body)
        if not last and (space := max(body.rfind(x) for x in (b" ", b"\n", b"\t", b"\r"))) > OVERLAP:
            end = space + 1
        self.visit(body[:end])
        back = 0 if last or end < len(body) else OVERLAP
        del self.window[: end - back]
        self.fed = len(body) - (end - back)


class _Unwrapped:
    """Streams found in bytes that come piece by piece: at their start, behind one another, and gzip behind anything."""

    def __init__(self, content):
        self.content, self.rest, self.d, self.start, self.held = content, b"", None, True, None

    def write(self, piece: bytes) -> None:
        self.rest += piece
        while self.rest:
            if self.d is None and not self._found():
                return
            if not self._step():
                return

    def close(self) -> None:
        if self.held:
            self.held.close()

    def _found(self) -> bool:
        at = 0
        if not (self.start and _packed(self.rest, 0)):
            if len(self.rest) < 3 and (self.start or self.rest[:1] == GZIP[:1]):
                return False
            at = self.rest.find(GZIP)
            if at < 0:
                self.rest, self.start = self.rest[-2:], False
                return False
        self.rest, self.start = self.rest[at:], False
        self.d, self.held = zlib.decompressobj(47), self.content()
        return True

    def _step(self) -> bool:
        """Inflates some of what is held; whether to go on with the rest."""
        data, before = self.rest[: 1 << 14], self.d.copy()
        try:
            self.held.write(self.d.decompress(data, PIECE))
        except zlib.error:
            try:
                for k in range(len(data)):
                    self.held.write(before.decompress(data[k : k + 1]))
            except zlib.error:
                pass
            self.rest = self.rest[max(k, 2) :]  # what is behind the damage, or behind a header that was none
            self._ended()
            return True
        used = len(data) - len(self.d.unused_data) - len(self.d.unconsumed_tail)
        self.rest = self.rest[used:]
        if self.d.eof:
            self.start = True
            self._ended()
        return True

    def _ended(self) -> None:
        self.held.close()
        self.d = self.held = None


def _members(raw: bytes):
    """(start, end) of the streams in ``raw``: at its start, behind one another, and gzip behind anything else."""
    at = 0
    while at < len(raw):
        if not _packed(raw, at) and (at := raw.find(GZIP, at)) < 0:
            return
        end, complete, any_ = _inflated(raw, at)
        if any_:
            yield at, end
        at = end if complete else at + 2


def _rough(raw: bytes):
    """(text, index of each character's first byte, bytes a character) of what may be read in bytes that are not clean."""
    if WORTH.search(raw):
        yield raw.decode("latin-1"), np.arange(len(raw)), 1
    for m in WIDE.finditer(raw):
        new = m[0][::2].decode("ascii")
        yield new, m.start() + 2 * np.arange(len(new)), 2


def _char_places(text: str, byte_places: np.ndarray) -> np.ndarray:
    """For each character of ``text`` the index of its first byte, mapped through ``byte_places``."""
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    return byte_places[np.flatnonzero((raw & 0xC0) != 0x80)]


def _replaced(layer: Layer | None, text: str, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every run of ``pattern`` decoded; None if nothing changes."""
    parts, starts, ends, at, changed = [], [], [], 0, False
    own_s = layer.starts if layer else None
    own_e = layer.ends if layer else None

    def keep(a: int, b: int) -> None:
        if b > a:
            parts.append(text[a:b])
            starts.append(own_s[a:b] if layer else np.arange(a, b))
            ends.append(own_e[a:b] if layer else np.arange(a + 1, b + 1))

    for m in pattern.finditer(text):
        if (new := decode(m[0])) is None or new == m[0]:
            continue
        keep(at, m.start())
        a, b = m.span()
        size = len(new)
        # The run's characters are shared out evenly over the new ones.
        lo = a + np.arange(size) * (b - a) // size
        hi = np.maximum(a + -(-np.arange(1, size + 1) * (b - a) // size), lo + 1)
        parts.append(new)
        starts.append(own_s[lo] if layer else lo)
        ends.append(own_e[hi - 1] if layer else hi)
        at, changed = b, True
    if not changed:
        return None
    keep(at, len(text))
    return Layer("".join(parts), np.concatenate(starts), np.concatenate(ends), bool(layer and layer.rough))


def _unquoted(run: str) -> str | None:
    raw = unquote_to_bytes(run)
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _unescaped(run: str) -> str | None:
    if run[0] == "&":
        return html.unescape(run)
    try:
        if run[1] == "u":
            units = [int(x, 16) for x in run.split("\\u")[1:]]
            return b"".join(u.to_bytes(2, "little") for u in units).decode("utf-16-le")
        return chr(int(run[2:], 16))
    except (UnicodeDecodeError, ValueError, OverflowError):
        return None


def _decoded(run: str) -> bytes:
    run = run[: len(run) - (len(run) % 4 == 1)]
    return base64.b64decode(run + "=" * (-len(run) % 4))


def _unpacked(layer: Layer | None, text: str, visit):
    """Layers held in base64 runs of ``text``; those of compressed content go to ``visit`` window by window."""
    above = bool(layer and layer.rough)

    def placed(new: str, lo: np.ndarray, hi: np.ndarray, rough: bool) -> Layer:
        return Layer(new, layer.starts[lo] if layer else lo, layer.ends[hi - 1] if layer else hi, rough or above)

    for m in BASE64_RUN.finditer(text):
        a, b = m.span()
        own = m[0].rstrip("=")
        run = own.translate(STANDARD)
        done: dict[int, int] = {}  # by place in a group of four: streams before here are known, and gzip ones behind it
        for p in PACKED.finditer(own):
            s = p.start()
            head = _decoded(run[s : s + 4])
            if not _packed(head, 0) or (s % 4 in done and (head == GZIP or s < done[s % 4])):
                continue
            done[s % 4] = s
            raw = _decoded(run[s:])
            for x, y in _members(raw):
                done[s % 4] = max(done[s % 4], s + y * 4 // 3)
                lo, hi = a + s + x * 4 // 3, a + s - (-y * 4 // 3)
                hi = b if hi >= a + len(own) - 1 else hi  # with the padding

                def seen(window: bytes, lo=lo, hi=hi) -> None:
                    if new := _printable(window):
                        visit(placed(new, np.full(len(new), lo), np.full(len(new), hi), False))
                    else:
                        for new, _, _ in _rough(window):
                            visit(placed(new, np.full(len(new), lo), np.full(len(new), hi), True))

                content = _Content(seen)
                _inflated(raw, x, content.write)
                content.close()
        behind = [0, *(x.end() for x in BEHIND.finditer(own))]
        clean = set()
        for s, e in {(0, len(own)), *(x.span() for pattern in PARTS for x in pattern.finditer(own) if len(behind) > 1)}:
            raw = _decoded(run[s:e])
            if new := _printable(raw):
                at = _char_places(new, np.arange(len(raw)))
                nxt = np.append(at[1:], len(raw))
                if e == len(own):
                    clean.add((s, e))
                yield placed(new, a + s + at * 4 // 3, np.minimum(a + s - (-nxt * 4 // 3), b if e == len(own) else a + e), False)
        for s in {x % 4: x for x in reversed(behind)}.values():
            if (s, len(own)) in clean or len(own) - s < 16:
                continue
            for new, at, width in _rough(_decoded(run[s:])):
                yield placed(new, a + s + at * 4 // 3, np.minimum(a + s - (-(at + width) * 4 // 3), b), True)


def _unwrapped(layer: Layer | None, text: str):
    """Base64 runs of ``text`` that are wrapped, each with its lines joined: to be decoded, not to be scanned itself."""
    for m in WRAPPED.finditer(text):
        raw = np.frombuffer(m[0].encode(), np.uint8)
        at = m.start() + np.flatnonzero((raw != 10) & (raw != 13))
        yield Layer(m[0].replace("\r", "").replace("\n", ""), layer.starts[at] if layer else at, layer.ends[at] if layer else at + 1, bool(layer and layer.rough))


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans): the second adds what the decoded layers hold, mapped to the original text."""
    base = base_spans(text)
    found, rough, seen = set(base), set(), set()

    def visit(first: Layer | None) -> None:
        work = [] if first is not None and (not len(first.text) or first.key() in seen) else [first]
        if first is not None and work:
            seen.add(first.key())
        while work:
            layer = work.pop()
            body = layer.text if layer else text
            if layer:
                for s, e, kind in base_spans(body):
                    (rough if layer.rough else found).add((int(layer.starts[s]), int(layer.ends[s:e].max()), kind))
            new = [_replaced(layer, body, URL_RUN, _unquoted) if "%" in body else None]
            new.append(_replaced(layer, body, ESCAPE, _unescaped) if "\\" in body or "&#" in body else None)
            wrapped = (x for w in _unwrapped(layer, body) for x in _unpacked(w, w.text, visit)) if "\n" in body else ()
            for x in [*new, *_unpacked(layer, body, visit), *wrapped]:
                if x is not None and len(x.text) and (k := x.key()) not in seen:
                    seen.add(k)
                    work.append(x)

    visit(None)
    known = {(s, kind) for s, _, kind in found}
    found |= {x for x in rough if (x[0], x[2]) not in known}
    return base, sorted(found, key=lambda x: (x[0], x[2], x[1]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def _scan(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            rows = []
            for text in part.column("text").to_pylist():
                base, every = all_spans(text or "")
                kinds = [k for _, _, k in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:3]], *[pa.array(c, pa.string()) for c in cols[3:]]],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row; a map over the table, without a shuffle."""
    return mapped(docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text"), _scan, SCHEMA)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


QUERIES = {"op6_secret_scan": op6_secret_scan}
ORACLES: dict[str, str] = {}
