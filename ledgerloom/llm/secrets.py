"""Secret scans with a recursive decoding worklist.

Each text is scanned as it stands (the base spans). Then a worklist unwraps it layer by
layer - percent escapes, Unicode escapes, base64, compressed bytes - until nothing new
appears. Every layer is scanned by the same patterns and carries a map from its characters
to the code points of the original text, so what is found deep inside is reported where it
lies in the document. A layer that was seen at the same place before is not unwrapped
again, which ends cycles such as archives that unpack to themselves.

Base64 goes on over line ends (also escaped ones) and is tried from its first sign, from
each line and behind each sign that is also used as a separator. All members of a compressed
layer are read. Of one that breaks off, what comes out before is scanned, and it is counted
in ``n_truncated``. Bytes of a compressed layer that are no UTF-8 become replacement signs;
base64 without compression is scanned in its readable stretches.

Escapes that lie more than ``DEEP`` layers deep are taken off at once by one pass from left to
right, so that a text of nothing but escaped escapes takes linear time; the layers between
aren't scanned one by one there.

Defined results: a null text counts as empty; empty texts have no spans; a payload that
cannot be decoded is left as it is; compressed layers over ``max_layer_bytes`` are counted in
``n_oversize``, unpacked as a stream through all compressed and long base64 layers inside them, and
scanned in overlapping pieces: memory doesn't grow with them. A secret longer than the overlap of
64 KB may be found in two spans there, and escapes that are compressed bytes end with a piece. Repeated rows give
repeated results; other columns pass through.
"""

from __future__ import annotations

import base64
import bisect
import bz2
import hashlib
import lzma
import re
import zlib
from array import array

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the kinds of secrets in the order in which they are listed, and their patterns
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2})+")
_UNICODE_ONE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
_SIGN, _LINE_END = "[A-Za-z0-9+/_-]", r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*"
# signs of 16 or more in a row; then whole lines of signs, and before them the short rest of a line
_BASE64 = re.compile(
    rf"(?:{_SIGN}{{4,15}}{_LINE_END}(?={_SIGN}{{16}}))?{_SIGN}{{16,}}+(?:{_LINE_END}{_SIGN}++(?![ \t]*[^\s=\"'\\<)\]}},;]))*={{0,2}}"
)
_NEXT_LINE = re.compile(_LINE_END)
_SEPARATOR = re.compile(r"[+/_-]")
_SIGNS = re.compile(f"{_SIGN}+")
_LINES, _SHORT_LINE = re.compile(f"{_SIGN}{{16,}}"), re.compile(f"{_LINE_END}({_SIGN}{{1,15}})(?!{_SIGN})")
_UNSETTLED = re.compile(rf"(?:[ \t\r\n\\]|(?<=\\)[rn]){{0,64}}{_SIGN}{{0,15}}$|$")
# stretches of valid UTF-8 without control signs
_READABLE = re.compile(
    rb"(?:[\x09-\x0d\x1b\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|"
    rb"\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)

# stretches of ASCII in two bytes a sign, either first
_WIDE = re.compile(rb"(?:[\x09\x0a\x0d\x20-\x7e]\x00){12,}|(?:\x00[\x09\x0a\x0d\x20-\x7e]){12,}")



def _shown_byte(b: int) -> str:
    """A pattern of a byte as an escape or, if it is a printable sign, as itself."""
    digits = "".join(f"[{d}{d.upper()}]" if d.isalpha() else d for d in f"{b:02x}")
    return "(?:" + "|".join([rf"(?:%|\\x|\\u00){digits}", *([re.escape(chr(b))] if 0x20 < b < 0x7F else [r"\\0"] if not b else [])]) + ")"


# fixed values: how compressed layers begin (gzip, zlib, bzip2, xz, zstd); a list holds the choices of one byte
_STARTS = [[0x1F, 0x8B], [0x78, [0x01, 0x5E, 0x9C, 0xDA]], [*b"BZh", list(b"123456789"), *b"1AY&SY"], [0xFD, *b"7zXZ", 0], [0x28, 0xB5, 0x2F, 0xFD]]
_ESCAPED_START = re.compile("|".join("".join("(?:" + "|".join(map(_shown_byte, x if isinstance(x, list) else [x])) + ")" for x in start) for start in _STARTS))
_ESCAPE = re.compile(r"%[0-9A-Fa-f]{2}")
_PART_OF_ONE = re.compile(r"(?:%[0-9A-Fa-f]?|\\(?:x[0-9A-Fa-f]?|u[0-9A-Fa-f]{0,3})?)$")
_BACKSLASHED = re.compile(r"\\x([0-9A-Fa-f]{2})|\\u00([0-9A-Fa-f]{2})|\\([nrtabfv0\\'\"])", re.DOTALL)
_SHORT = {"n": "\n", "r": "\r", "t": "\t", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\\": "\\", "'": "'", '"': '"'}

#: the shortest secret: a stretch of fewer bytes holds none
_LEAST = 12
#: bytes read at once, written at once, and those that two pieces of a very large layer share
_FEED, _PIECE, _OVERLAP = 4096, 4 << 20, 1 << 16
_FAULTS = (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError)

#: the longest file name or comment in a gzip header
NAME = 4096

MAX_LAYER_BYTES = 32 << 20
#: from so many layers on escapes are taken off all at once
DEEP = 24


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the secrets that stand in ``text`` itself."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    out.sort()
    return out


def show_spans(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


class _Layer:
    """A decoded text; ``starts[i]``/``ends[i]`` bound the original code points behind character i.

    With ``fixed``, all characters have that span, since they come out of one compressed payload.
    """

    __slots__ = ("text", "starts", "ends", "fixed")

    def __init__(self, text, starts=None, ends=None, fixed=None):
        self.text, self.starts, self.ends, self.fixed = text, starts, ends, fixed

    def span(self, start, end):
        if self.fixed:
            return self.fixed
        return (start, end) if self.starts is None else (self.starts[start], self.ends[end - 1])

    def key(self):
        where = self.span(0, len(self.text))
        return hashlib.sha1(self.text.encode("utf-8", "surrogatepass")).digest(), where


def _rewritten(layer: _Layer, runs) -> _Layer | None:
    """A copy of the whole layer with some runs replaced; runs yields (start, end, [(char, start, end)])."""
    parts, starts, ends, at, changed = [], array("q"), array("q"), 0, False

    def keep(i, j):
        parts.append(layer.text[i:j])
        if layer.fixed:
            return
        starts.extend(range(i, j) if layer.starts is None else layer.starts[i:j])
        ends.extend(range(i + 1, j + 1) if layer.ends is None else layer.ends[i:j])

    for i, j, chars in runs:
        keep(at, i)
        for c, s, e in chars:
            s, e = layer.span(s, e)
            parts.append(c)
            if not layer.fixed:
                starts.extend([s] * len(c))
                ends.extend([e] * len(c))
        at, changed = j, True
    if not changed:
        return None
    keep(at, len(layer.text))
    text = "".join(parts)
    return _Layer(text, starts, ends, layer.fixed) if text and text != layer.text else None


def _percent(layer: _Layer) -> _Layer | None:
    def runs():
        for m in _PERCENT.finditer(layer.text):
            raw = bytes.fromhex(m[0].replace("%", ""))
            chars, at = [], m.start()
            for c in raw.decode("utf-8", "surrogateescape"):
                if "\udc80" <= c <= "\udcff":  # a byte that is no part of a character stays escaped
                    chars += [(layer.text[at + i], at + i, at + i + 1) for i in range(3)]
                    at += 3
                else:
                    n = 3 * len(c.encode())
                    chars.append((c, at, at + n))
                    at += n
            yield m.start(), m.end(), chars

    return _rewritten(layer, runs()) if "%" in layer.text else None


def _unicode(layer: _Layer) -> _Layer | None:
    def runs():
        for m in _UNICODE.finditer(layer.text):
            chars = []
            for x in _UNICODE_ONE.finditer(layer.text, m.start(), m.end()):
                code = int(next(g for g in x.groups() if g), 16)
                if 0xDC00 <= code < 0xE000 and chars and "\ud800" <= chars[-1][0] < "\udc00" and chars[-1][2] == x.start():
                    high, s, _ = chars.pop()
                    chars.append((chr(0x10000 + ((ord(high) - 0xD800) << 10) + code - 0xDC00), s, x.end()))
                else:
                    chars.append((chr(code) if code < 0x110000 else x[0], x.start(), x.end()))
            # a lone half of a pair is no character: it stays escaped
            chars = [(layer.text[s:e] if "\ud800" <= c[0] < "\ue000" else c, s, e) for c, s, e in chars]
            yield m.start(), m.end(), chars

    return _rewritten(layer, runs()) if "\\" in layer.text else None


_HEX_DIGITS = frozenset("0123456789abcdefABCDEF")
#: escapes as they end: the sign before the digits, and their number
_ENDINGS = (("%", 2), ("\\x", 2), ("\\u", 4), ("\\U", 8))


def _settled(layer: _Layer) -> _Layer | None:
    """The layer without any escapes, nested ones too: each sign is put down, and what then ends in an escape is replaced."""
    out: list[tuple[str, int, int]] = []  # signs, bytes above 127 as \udcXX, with their places

    def ending() -> tuple[int, int] | None:
        """How many signs the escape at the end has, and its code."""
        if out[-1][0] == "}":
            for n in range(5, min(len(out), 10) + 1):
                if out[-n][0] == "\\":
                    shown = "".join(c for c, _, _ in out[-n:])
                    m = _UNICODE_ONE.fullmatch(shown)
                    return (n, int(m[1], 16)) if m and m[1] and int(m[1], 16) < 0x110000 else None
            return None
        if out[-1][0] not in _HEX_DIGITS:
            return None
        for sign, digits in _ENDINGS:
            n = len(sign) + digits
            if len(out) >= n and out[-n][0] == sign[0]:
                shown = "".join(c for c, _, _ in out[-n:])
                if shown.startswith(sign) and _HEX_DIGITS.issuperset(shown[len(sign) :]):
                    code = int(shown[len(sign) :], 16)
                    if sign == "%" and code > 127:
                        return n, 0xDC00 + code
                    return (n, code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None
        return None

    changed = False
    for i, c in enumerate(layer.text):
        out.append((c, i, i + 1))
        while (found := ending()) is not None:
            n, code = found
            out[-n:] = [(chr(code), out[-n][1], out[-1][2])]
            changed = True
    if not changed:
        return None

    def runs():
        at, last = 0, len(out)
        while at < last:
            c, s, e = out[at]
            if not "\udc80" <= c <= "\udcff" or e - s == 1:
                if c != layer.text[s:e]:
                    yield s, e, [(c, s, e)]
                at += 1
                continue
            end = at
            while end < last and "\udc80" <= out[end][0] <= "\udcff" and out[end][2] - out[end][1] > 1:
                end += 1
            chars, k = [], at
            for x in bytes(ord(b) - 0xDC00 for b, _, _ in out[at:end]).decode("utf-8", "surrogateescape"):
                n = 1 if "\udc80" <= x <= "\udcff" else len(x.encode())
                s, e = out[k][1], out[k + n - 1][2]
                # a byte that is no part of a character stays escaped
                chars += [(x, s, e)] if n > 1 else [(d, s, e) for d in f"%{ord(x) - 0xDC00:02X}"]
                k += n
            yield out[at][1], out[end - 1][2], chars
            at = end

    return _rewritten(layer, runs())


class _Cut(bytes):
    """What came out of a compressed layer that breaks off."""


def _tool(raw: bytes):
    """(decompressor, bytes to feed at once, limits of its output) by the first bytes; None if they aren't those of a compressed layer."""
    if raw[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31), _FEED, ()
    if len(raw) > 2 and raw[0] == 0x78 and not (raw[0] * 256 + raw[1]) % 31:
        return zlib.decompressobj(), _FEED, ()
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor(), _FEED, (_PIECE,)
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(), _FEED, (_PIECE,)
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj(), 64, ()
    return None


def _member(raw: bytes):
    """The output of one member in pieces; returns what follows it, or None if it breaks off."""
    given, fault = 0, len(raw)
    while True:
        (tool, size, limits), at, start, passed = _tool(raw), 0, 0, 0
        try:
            while not tool.eof:
                feed = b""
                if getattr(tool, "needs_input", True):
                    # from the fault on byte by byte, so that nothing before it is lost
                    start, feed = at, raw[at : at + (size if at < fault else 1)]
                    at += len(feed)
                    if not feed:
                        return None
                out = tool.decompress(feed, *limits)
                passed += len(out)
                if passed > given:
                    yield out[len(out) - (passed - given) :]
                    given = passed
            return tool.unused_data + raw[at:]
        except Exception as e:
            if not isinstance(e, _FAULTS) and type(e).__name__ != "ZstdError":
                raise
            if fault < len(raw):
                return None
            fault = start


def _members(raw: bytes):
    """The output of all members of a compressed layer in pieces; a last None if it breaks off."""
    while raw is not None and _tool(raw) is not None:
        raw = yield from _member(raw)
        if raw is None:
            yield None
            return
        if raw[:1] == b"\x00":
            raw = raw.lstrip(b"\x00")


def _gzip_head(raw: bytes, at: int) -> str | None:
    """"fault" or "more" for a header that can't be one, or isn't complete; names and comments have at most NAME bytes."""
    if len(raw) < at + 12:
        return "more"
    flags, at = raw[at + 3], at + 10
    if raw[at - 8] != 8 or flags & 0xE0:
        return "fault"
    if flags & 4:  # fields, each with its own length, fill the extra bytes exactly
        end = at + 2 + int.from_bytes(raw[at : at + 2], "little")
        at += 2
        while at < end:
            if len(raw) < at + 4:
                return "more"
            at += 4 + int.from_bytes(raw[at + 2 : at + 4], "little")
        if at > end:
            return "fault"
    for bit in (8, 16):
        if flags & bit:
            stop = raw.find(b"\0", at, at + NAME)
            if stop < 0:
                return "fault" if len(raw) >= at + NAME else "more"
            at = stop + 1
    return None


def _reach(raw: bytes) -> tuple[str, int]:
    """How far the members at the start of ``raw`` go: ("done", their bytes), ("edge", ...) if another may begin with the last bytes, ("more", ...) if one goes on behind it, ("fault", ...)."""
    at = 0
    while True:
        while raw[at : at + 1] == b"\x00" and at:
            at += 1
        if (found := _tool(raw[at : at + 8])) is None:
            return ("edge" if at else "more") if len(raw) - at < 8 else "done", at
        tool, size, limits = found
        if raw[at : at + 2] == b"\x1f\x8b" and (state := _gzip_head(raw, at)):
            return state, at
        try:
            while not tool.eof:
                feed = b""
                if getattr(tool, "needs_input", True):
                    feed = raw[at : at + size]
                    at += len(feed)
                    if not feed:
                        return "more", at
                tool.decompress(feed, *limits)
            at -= len(tool.unused_data)
        except Exception as e:
            if not isinstance(e, _FAULTS) and type(e).__name__ != "ZstdError":
                raise
            return "fault", at


def _from(read, length: int) -> tuple[bytes, bool]:
    """The bytes of a compressed layer, of which ``read(n)`` gives those behind the first ``n`` signs, and whether more was there.

    Read in growing parts, until the layer ends or breaks, so that the many false starts in a text cost little each.
    """
    size = 512
    while True:
        raw = read(size)
        state, at = _reach(raw)
        if state not in ("more", "edge") or size >= length:
            return raw, state in ("done", "edge")
        size *= 4


def _unpacked(raw: bytes, limit: int) -> bytes | None:
    """One compressed layer less; None if ``raw`` isn't compressed. Raises OverflowError above ``limit``."""
    parts, n, cut = [], 0, False
    for out in _members(raw):
        if out is None:
            cut = True
            continue
        parts.append(out)
        n += len(out)
        if n > limit:
            raise OverflowError
    if not parts:
        return None
    return _Cut(b"".join(parts)) if cut else b"".join(parts)


class _Flow:
    """A layer that comes in pieces and is never held as a whole; ``feed`` and ``close`` yield what there is to scan.

    A compressed one is unpacked into a flow of its own. Any other is scanned in overlapping
    pieces; base64 runs longer than the overlap are decoded on the way into further flows.
    """

    def __init__(self, where, limit: int, seen: frozenset = frozenset(), packed: bool = False):
        self.where, self.limit, self.seen, self.packed = where, limit, seen, packed
        self.size = max(min(limit, _PIECE), 2)
        self.shared = min(_OVERLAP, self.size // 2)
        self.held, self.old, self.child, self.tool, self.limits, self.state = b"", 0, None, None, (), "head"
        self.runs = _Runs(self)

    def feed(self, data: bytes):
        if self.state == "head":
            self.held += data
            if len(self.held) >= _FEED:
                yield from self._open()
        elif self.state == "packed":
            yield from self._unpack(data)
        elif self.state == "plain":
            yield from self._scan(data)

    def _open(self):
        head, self.held = self.held, b""
        start = head[:_FEED]
        if start not in self.seen and _tool(start) is not None and _unpacked(start, 1 << 30):  # else it unpacks to itself, or is no compressed layer
            self.state, self.child = "packed", _Flow(self.where, self.limit, self.seen | {start})
        else:
            self.state = "over" if self.packed else "plain"
        yield from self.feed(head)

    def _unpack(self, data: bytes):
        self.held, at = self.held + data, 0
        while at < len(self.held):
            if self.tool is None:
                while self.held[at : at + 1] == b"\x00":
                    at += 1
                if len(self.held) - at < 8:
                    break
                if (found := _tool(self.held[at : at + 8])) is None:
                    self.state = "over"
                    return
                self.tool, _, self.limits = found
            feed = self.held[at : at + _FEED]
            at += len(feed)
            try:
                while True:
                    out = self.tool.decompress(feed, *self.limits)
                    if out:
                        yield from self.child.feed(out)
                    if self.tool.eof:
                        at, self.tool = at - len(self.tool.unused_data), None
                        break
                    if getattr(self.tool, "needs_input", True):
                        break
                    feed = b""
            except Exception as e:
                if not isinstance(e, _FAULTS) and type(e).__name__ != "ZstdError":
                    raise
                yield TRUNCATED
                self.state = "over"
                return
        self.held = self.held[at:]

    def _scan(self, data: bytes):
        for k in range(0, len(data), self.size):
            self.held += data[k : k + self.size]
            while len(self.held) >= self.size:
                yield _Layer(self.held[: self.size].decode("utf-8", "replace"), fixed=self.where)
                self.held, self.old = self.held[self.size - self.shared :], self.shared
        yield from self.runs.feed(data)

    def close(self):
        if self.state == "head":
            yield from self._open()
        if self.state == "plain":
            yield from self.runs._last(self.runs.carry, 0)
            if len(self.held) > self.old:
                yield _Layer(self.held.decode("utf-8", "replace"), fixed=self.where)
        elif self.child:
            if self.state == "packed" and self.tool is not None:
                yield TRUNCATED
            yield from self.child.close()
        self.state = "done"


class _Runs:
    """Follows the base64 runs of a flow; one that is longer than what pieces share is decoded as it comes."""

    def __init__(self, flow: _Flow):
        self.flow, self.carry, self.open = flow, "", False
        self._start()

    def _start(self) -> None:
        self.length, self.waiting, self.tail, self.decoders = 0, [], "", None

    def feed(self, data: bytes):
        """Stretches of 16 and more signs, which are whole lines of a run, and the short line behind the last of them."""
        text, at = self.carry + data.decode("latin-1"), 0
        if self.open and (m := _SIGNS.match(text)):  # the last stretch goes on
            at = m.end()
            yield from self._signs(m[0], False)
        # a stretch or gap that the next piece may go on with stays for it
        stop = len(text) - len(_UNSETTLED.search(text, max(len(text) - 160, at))[0]) if at < len(text) else len(text)
        for m in _LINES.finditer(text, at, max(stop, at)):
            if m.start() > at or not self.length:
                gap = _NEXT_LINE.fullmatch(text, at, m.start()) if self.length else None
                if not gap:
                    yield from self._last(text, at)
                yield from self._signs(m[0], bool(gap))
            else:
                yield from self._signs(m[0], False)
            at = m.end()
        if at < stop and not _NEXT_LINE.fullmatch(text, at, stop):
            yield from self._last(text, at)
            at = stop
        self.open = at == len(text) and self.length > 0
        self.carry = text[at:] if self.length else text[stop:]

    def _last(self, text: str, at: int):
        """The run ends at ``at``, or with a short line behind it."""
        if self.length and (m := _SHORT_LINE.match(text, at)):
            yield from self._signs(m[1], True)
        yield from self.end()

    def _signs(self, code: str, line: bool):
        code = code.replace("-", "+").replace("_", "/")
        self.length += len(code)
        if self.decoders is None:
            self.waiting.append((code, line))
            if self.length <= self.flow.shared:
                return
            # the four ways in which signs can be grouped, read as text
            self.decoders = [[skip, "", _Flow(self.flow.where, self.flow.limit)] for skip in range(4)]
            waiting, self.waiting = self.waiting, []
            for part, begins in waiting:
                yield from self._decode(part, begins)
        else:
            yield from self._decode(code, line)

    def _decode(self, code: str, line: bool):
        for d in self.decoders:
            yield from self._push(d, code)
        # compressed payloads may begin with a line or behind a sign that is also a separator; they are known by 8 signs
        known = len(self.tail)
        text = self.tail + code
        if line or self.tail == "" and not known:
            yield from self._try(text, known)
        for m in _SEPARATOR.finditer(text, max(known - 8, 0)):
            if m.end() + 8 <= len(text) and (m.end() + 8 > known):
                yield from self._try(text, m.end())
        self.tail = text[-16:]
        self.decoders = [d for d in self.decoders if d[2].state != "over"]

    def _try(self, text: str, begin: int):
        if len(text) - begin >= 8 and _tool(_decoded(text[begin : begin + 8])) is not None:
            d = [0, "", _Flow(self.flow.where, self.flow.limit, packed=True)]
            self.decoders.append(d)
            yield from self._push(d, text[begin:])

    @staticmethod
    def _push(d: list, code: str):
        """Decode all whole groups of signs."""
        skip = min(d[0], len(code))
        d[0] -= skip
        code = d[1] + code[skip:]
        whole = len(code) // 4 * 4
        d[1] = code[whole:]
        if whole:
            yield from d[2].feed(base64.b64decode(code[:whole]))

    def end(self):
        decoders = self.decoders or []
        for _, rest, flow in decoders:
            if len(rest) > 1:
                yield from flow.feed(_decoded(rest))
            yield from flow.close()
        self._start()


def _run(text: str, start: int, end: int):
    """The signs of a base64 run without its line ends, the place of each, and where payloads may begin."""
    places, parts, lines, at = array("q"), [], [0], start
    for m in _NEXT_LINE.finditer(text, start, end):
        parts.append(text[at : m.start()])
        places.extend(range(at, m.start()))
        lines.append(len(places))
        at = m.end()
    parts.append(text[at:end])
    places.extend(range(at, end))
    code = "".join(parts).rstrip("=")
    return code, places, sorted({*lines, *(m.end() for m in _SEPARATOR.finditer(code))})


def _decoded(code: str) -> bytes:
    if len(code) % 4 == 1:
        code = code[:-1]
    return base64.b64decode(code + "=" * (-len(code) % 4), altchars=b"-_" if "-" in code or "_" in code else None)


def _packed(raw: bytes, where, limit: int):
    """What lies behind the compressed layers of a payload."""
    seen, packed, first = set(), False, raw
    try:
        while (out := _unpacked(raw, limit)) is not None:
            if isinstance(out, _Cut):
                yield TRUNCATED
            digest = hashlib.sha1(raw).digest()
            if digest in seen:  # it unpacks to itself
                break
            seen.add(digest)
            raw, packed = bytes(out), True
    except OverflowError:
        yield OVERSIZE
        flow, cut = _Flow(where, limit), False
        for piece in _members(raw):
            for found in flow.feed(piece) if piece is not None else (TRUNCATED,):
                if found.__class__ is str:
                    cut = True
                else:
                    yield found
        for found in flow.close():
            if found.__class__ is str:
                cut = True
            else:
                yield found
        if cut:
            yield TRUNCATED
        return
    if packed and raw and raw != first:
        yield _Layer(raw.decode("utf-8", "replace"), fixed=where)


OVERSIZE, TRUNCATED = "oversize", "truncated"


def _blobs(layer: _Layer, limit: int):
    """Layers behind the base64 runs of a layer; OVERSIZE and TRUNCATED tell of a payload that is too large or breaks off."""
    for m in _BASE64.finditer(layer.text):
        code, places, begins = _run(layer.text, m.start(), m.end())
        code = code.replace("-", "+").replace("_", "/")
        plain: set[int] = set()
        done = 0
        for begin in begins:
            if len(code) - begin < 4:
                break
            head = _decoded(code[begin : begin + 8])
            if begin >= done and _tool(head) is not None and len(code) - begin >= 16:
                raw, whole = _from(lambda n, b=begin: _decoded(code[b : b + n]), len(code) - begin)
                yield from _packed(raw, layer.span(places[begin], m.end()), limit)
                if whole:  # starts inside it aren't starts
                    done = begin + _reach(raw)[1] * 8 // 6
            if begin % 4 in plain:
                continue
            plain.add(begin % 4)
            raw = _decoded(code[begin:])
            for x, wide in [*((x, 0) for x in _READABLE.finditer(raw)), *((x, 1) for x in _WIDE.finditer(raw))]:
                if x.end() - x.start() < _LEAST:
                    continue
                text, at, starts, ends = (x[0].replace(b"\x00", b"") if wide else x[0]).decode(), x.start(), array("q"), array("q")
                for c in text:
                    n = 2 if wide else len(c.encode()) if ord(c) > 127 else 1
                    s, e = layer.span(places[begin + at * 8 // 6], places[begin - (-(at + n) * 8 // 6) - 1] + 1)
                    starts.append(s)
                    ends.append(e)
                    at += n
                yield _Layer(text, starts, ends)


def _escaped_bytes(text: str, percent: bool, plus: bool) -> bytes:
    """The bytes that a text with escapes stands for; up to the first sign that is no byte."""
    if percent:
        text = _PERCENT.sub(lambda m: bytes.fromhex(m[0].replace("%", "")).decode("latin-1"), text.replace("+", " ") if plus else text)
    else:
        text = _BACKSLASHED.sub(lambda m: _SHORT[m[3]] if m[3] else chr(int(m[1] or m[2], 16)), text)
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError as e:
        return text[: e.start].encode("latin-1")


def _escaped_blobs(layer: _Layer, limit: int):
    """Layers behind compressed bytes that are written as escapes, with all other signs as they are."""
    text, done = layer.text, 0
    if "%" not in text and "\\" not in text:
        return
    for m in _ESCAPED_START.finditer(text):
        if m.start() < done:
            continue
        percent = "%" in m[0] if "%" in m[0] or "\\" in m[0] else "%" in text[m.end() : m.end() + 64]
        for plus in (False, True) if percent else (False,):  # a plus sign may stand for a space

            def read(n: int, b: int = m.start(), plus: bool = plus) -> bytes:
                part = text[b : b + n]
                return _escaped_bytes(_PART_OF_ONE.sub("", part) if b + n < len(text) else part, percent, plus)

            raw, whole = _from(read, len(text) - m.start())
            if whole or not percent or plus or "+" not in text[m.start() : m.start() + len(raw) * 3]:
                break
        if next(filter(None, _members(raw)), None) is None:  # no byte comes out: a false start
            continue
        size = _reach(raw)[1]
        # the signs that the bytes take
        end = m.start() + bisect.bisect_left(range(min(6 * size, len(text) - m.start())), True, key=lambda n: read(n)[:size] == raw[:size])
        if last := (_ESCAPE if percent else _BACKSLASHED).match(text, end - 1):  # its first sign alone would give the same byte
            end = last.end()
        yield from _packed(raw, layer.span(m.start(), max(end, m.end())), limit)
        if whole:
            done = end


def _below(layer: _Layer, limit: int, depth: int = 0):
    yield from filter(None, (_settled(layer),) if depth == DEEP else (_percent(layer), _unicode(layer)))
    yield from _escaped_blobs(layer, limit)
    yield from _blobs(layer, limit)


def _unwrap(text: str, max_layer_bytes: int = MAX_LAYER_BYTES) -> tuple[list, list, int, int, int]:
    """As ``unwrap``, and the number of compressed layers that break off."""
    base = find_spans(text)
    spans, layers, marks = set(base), 0, {OVERSIZE: 0, TRUNCATED: 0}
    work, seen = [_below(_Layer(text), max_layer_bytes)] if text else [], set()
    while work:
        # one layer at a time at each depth: pieces of very large layers aren't held together
        below = next(work[-1], None)
        if below is None:
            work.pop()
        elif below.__class__ is str:
            marks[below] += 1
        elif (key := below.key()) not in seen:
            seen.add(key)
            layers += 1
            for s, k, e in find_spans(below.text):
                s, e = below.span(s, e)
                spans.add((s, k, e))
            work.append(_below(below, max_layer_bytes, len(work)))
    return base, sorted(spans), layers, marks[OVERSIZE], marks[TRUNCATED]


def unwrap(text: str, max_layer_bytes: int = MAX_LAYER_BYTES) -> tuple[list, list, int, int]:
    """Base spans, all spans, the number of layers below the text, and of layers taken in pieces as too large."""
    return _unwrap(text, max_layer_bytes)[:4]


def scan_secrets(docs: DataFrame, text: str = "text", max_layer_bytes: int = MAX_LAYER_BYTES) -> DataFrame:
    """Replace the text column by what was found in it.

    Adds n_assign, n_access, n_hex, base_spans, spans (strings kind:start:end, comma-joined),
    n_layers, n_oversize and n_truncated; every row stays. One pass over the rows, no shuffle.
    """
    keep = [c for c in docs.columns if c != text]
    found = ["n_assign", "n_access", "n_hex", "base_spans", "spans", "n_layers", "n_oversize", "n_truncated"]
    clash = set(keep) & set(found)
    docs = docs.drop(*clash)
    keep = [c for c in keep if c not in clash]

    def run(batches):
        for pdf in batches:
            rows = []
            for x in pdf[text]:
                base, spans, *layers = _unwrap(x if isinstance(x, str) else "", max_layer_bytes)
                counts = [0, 0, 0]
                for _, k, _ in base:
                    counts[k] += 1
                rows.append((*counts, show_spans(base), show_spans(spans), *layers))
            out = pdf[keep].reset_index(drop=True)
            out[found] = pd.DataFrame(rows, columns=found, index=out.index)
            yield out

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.select(keep).dtypes)
    more = "n_assign long, n_access long, n_hex long, base_spans string, spans string, n_layers long, n_oversize long, n_truncated long"
    return docs.select(*keep, text).mapInPandas(run, f"{kinds}, {more}" if kinds else more)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by ``mark``; overlapping spans become one mark.

    Columns stay as they are, but for ``text`` and, where there is one, ``n_chars``.
    """
    sized = "n_chars" in docs.columns

    def clean(x):
        if not isinstance(x, str):
            return x
        spans = unwrap(x)[1]
        if not spans:
            return x
        parts, at = [], 0
        for s, _, e in spans:
            if s >= at:
                parts += [x[at:s], mark]
            at = max(at, e)
        return "".join([*parts, x[at:]])

    def run(batches):
        for pdf in batches:
            new = pdf[text].map(clean)
            if sized:
                changed = new.ne(pdf[text]) & new.notna()
                pdf["n_chars"] = pdf["n_chars"].mask(changed, new.str.len())
            pdf[text] = new
            yield pdf

    return docs.mapInPandas(run, docs.schema)


def secrets_report(docs: DataFrame) -> DataFrame:
    """The digest columns of query op4."""
    return scan_secrets(docs.select("doc_id", "text")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans",
        "n_layers", "n_oversize", "n_truncated",
    )
