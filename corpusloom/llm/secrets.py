"""Secret scans with a recursive decoding worklist.

Every layer of a text is scanned with the same patterns: the text itself; the whole text with its URL escapes decoded, or its
Unicode escapes; and whatever its base64 and compressed parts unwrap to; and so on for each layer, until nothing new comes
out. A digest of each layer stops cycles. Each character of a layer knows the stretch of the original text that it comes
from, so what is found is reported at its own place there: escapes by the character, what was packed by its whole code.

Defined cases: a null text is scanned as the empty one; rows are kept as they are, repeated or not; extra columns of the
input are ignored or passed on. Bytes that aren't UTF-8 are scanned as Latin-1, those with NULs as UTF-16 and UTF-32 too; of
such layers only those that hold something count as opened. A layer larger than `MAX_LAYER` bytes after decompression isn't
held whole: it is scanned in overlapping windows, cut between runs of what secrets and codes consist of (a run longer than half
a window is cut inside), and counted in n_unopened. Streams packed in each other more than `DEPTH` times are scanned as they
are there, since some unpack to themselves.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import itertools
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import pieces
from .shared import table

KINDS = ("assign", "access", "hex")
MAX_LAYER = 64 << 20
DEPTH, STEP, OVERLAP = 64, 1 << 20, 1 << 16
_any_case = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_NAMES = "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + "|" + _any_case("api") + "_?" + _any_case("key")
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: Runs are maximal or start at the first AKIA, so the least length can stand in the pattern without another outcome.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Escapes; escaped marks before an escape (%2525, \\u005cu005c) are taken with it, since what they leave holds no secret of its own.
_PERCENT = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
_PERCENTS = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\(?:u005[Cc]|x5[Cc])*(?:u([Dd][89ABab][0-9A-Fa-f]{2})\\(?:u005[Cc]|x5[Cc])*u([Dd][C-Fc-f][0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_BREAK = re.compile(r"\r?\n[\x20\t]*")
#: Lines of base64, of which the last one may be short.
_WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]{16,})*(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)?={0,2}")
#: Bytes of secrets, codes and broken lines of them, in any of the encodings.
_INSIDE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=%\\:.\"' \t\r\n\0"

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the patterns' matches in one layer."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if ":" in text or "=" in text else []
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


class Layer:
    """A text, and for each of its characters the stretch [first, last) of the original text that it comes from; None: its own place."""

    __slots__ = ("first", "last", "text")

    def __init__(self, text: str, first: np.ndarray | None = None, last: np.ndarray | None = None):
        self.text, self.first, self.last = text, first, last

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.first is None else (int(self.first[a]), int(self.last[a:b].max()))

    def unescaped(self, rule: re.Pattern, chars: Callable[[re.Match], list[tuple[str, int, int]]]) -> Layer | None:
        """The whole layer with the matches replaced; chars: characters and their own places. None if nothing changes."""
        text, first, last, at = [], [], [], 0
        for m in rule.finditer(self.text):
            if got := chars(m):
                text += [self.text[at : m.start()], *(c for c, _, _ in got)]
                plain = np.arange(at, m.start())
                first += [plain, np.array([a for _, a, _ in got])]
                last += [plain, np.array([b - 1 for _, _, b in got])]
                at = m.end()
        if not at:
            return None
        text.append(self.text[at:])
        plain = np.arange(at, len(self.text))
        first, last = np.concatenate([*first, plain]), np.concatenate([*last, plain])
        if self.first is None:
            return Layer("".join(text), first, last + 1)
        return Layer("".join(text), self.first[first], self.last[last])


def _percents(m: re.Match) -> list[tuple[str, int, int]]:
    """The characters of a run of URL escapes; if its bytes aren't UTF-8, those that can be read, each from the whole run."""
    codes = list(_PERCENT.finditer(m[0]))
    raw = bytes(int(c[1], 16) for c in codes)
    try:
        chars = raw.decode()
    except UnicodeDecodeError:
        return [(c, m.start(), m.end()) for c in raw.decode("utf-8", "replace")]
    out, k = [], 0
    for c in chars:
        n = len(c.encode())
        out.append((c, m.start() + codes[k].start(), m.start() + codes[k + n - 1].end()))
        k += n
    return out


def _char(m: re.Match) -> list[tuple[str, int, int]]:
    if m[1]:
        c = chr(0x10000 + ((int(m[1], 16) & 0x3FF) << 10) + (int(m[2], 16) & 0x3FF))
    else:
        x = int(m[3] or m[4] or m[5], 16)
        if x >= 0x110000 or 0xD800 <= x < 0xE000:
            return []
        c = chr(x)
    return [(c, m.start(), m.end())]


def _packed(head: bytes) -> bool:
    return head[:2] == b"\x1f\x8b" or len(head) > 2 and head[0] & 15 == 8 and (head[0] << 8 | head[1]) % 31 == 0


def _inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What all members of a compressed stream hold, some bytes at a time; after the last or a damaged one, the rest as it is."""
    d, plain = zlib.decompressobj(47), False
    for data in chunks:
        while not plain:
            if d is None:  # between members
                data = data.lstrip(b"\0")
                if not data:
                    break
                if not _packed(data):
                    plain = True
                    yield b"\n"
                    break
                d = zlib.decompressobj(47)
            try:
                out = d.decompress(data, STEP)
            except zlib.error:
                plain = True
                yield b"\n"
                break
            yield out
            if d.eof:
                data, d = d.unused_data, None
            else:
                data = d.unconsumed_tail
                if not data and len(out) < STEP:
                    break
        if plain:
            yield data


def _unpacked(chunks: Iterator[bytes]) -> Iterator[bytes]:
    for _ in range(DEPTH):
        head = b""
        for more in chunks:
            head += more
            if len(head) > 2:
                break
        chunks = itertools.chain([head], chunks)
        if not _packed(head):
            break
        chunks = _inflated(chunks)
    return chunks


def _windows(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes at once or, if they are more than MAX_LAYER, in windows that overlap."""
    held = bytearray()
    for more in chunks:
        held += more
        if len(held) > MAX_LAYER:
            yield bytes(held)
            cut = min(len(held.rstrip(_INSIDE)), len(held) - OVERLAP)
            del held[: cut if 2 * cut > len(held) else len(held) - OVERLAP]
    yield bytes(held)


def _readings(raw: bytes) -> Iterator[tuple[str, bool]]:
    """The texts that bytes can be read as, and whether they plainly are that text."""
    try:
        s = raw.decode()
        some = s[: 1 << 16]
        yield s, bool(s) and sum(not c.isprintable() and c not in "\t\n\r" for c in some) * 20 <= len(some)
    except UnicodeDecodeError:
        yield raw.decode("latin-1"), False
    if b"\0" in raw:  # whatever the order of bytes, characters of ASCII are in one of these
        for code, width in (("utf-16-le", 2), ("utf-32-le", 4)):
            if b"\0" * (width - 1) in raw:
                for k in range(width):
                    yield (raw[k:] + bytes(-(len(raw) - k) % width)).decode(code, "replace"), False


def _decoded(code: str) -> Iterator[tuple[str | None, bool]]:
    """What base64 unwraps to. None: it is too large to hold, and comes in windows; False: bytes read as text on trial."""
    code = code.rstrip("=")
    if len(code) % 4 == 1 or code.isalpha() and (code.islower() or code[1:].islower()):
        return  # a length that base64 can't have, or a plain word
    try:
        raw = base64.b64decode(code.replace("-", "+").replace("_", "/") + "=" * (-len(code) % 4), validate=True)
    except binascii.Error:
        return
    for k, window in enumerate(_windows(_unpacked(iter([raw])))):
        if k == 1:
            yield None, False
        yield from _readings(window)


def layers(layer: Layer) -> Iterator[tuple[Layer | None, bool]]:
    """The layers that a layer unwraps to, and whether they plainly are text; None where windows of a larger one follow."""
    text = layer.text
    if "%" in text and (got := layer.unescaped(_PERCENTS, _percents)):
        yield got, True
    if "\\" in text and (got := layer.unescaped(_ESCAPE, _char)):
        yield got, True

    def packed(a: int, b: int, code: str) -> Iterator[tuple[Layer | None, bool]]:
        first, last = layer.span(a, b)
        for content, plain in _decoded(code):
            yield content if content is None else Layer(content, *(np.broadcast_to(np.int64(x), max(1, len(content))) for x in (first, last))), plain

    for m in _BASE64.finditer(text):
        yield from packed(m.start(), m.end(), m[0])
    for m in _WRAPPED.finditer(text) if "\n" in text else ():
        if "\n" in m[0]:
            yield from packed(m.start(), m.end(), _BREAK.sub("", m[0]))
            last = [*_BREAK.finditer(m[0])][-1].start()  # the last line may be the text that goes on
            yield from packed(m.start(), m.start() + last, _BREAK.sub("", m[0][:last]))


def scan(text: str) -> tuple[list[Span], list[Span], int, int]:
    """Base spans; those that layers add, without repeats; the number of layers opened; and of those read in windows."""
    base = base_spans(text)
    base.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    digest = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).digest()
    found, seen, opened, unopened = set(), {(0, len(text), digest(text))}, 0, 0
    work = [layers(Layer(text))]
    while work:
        item = next(work[-1], None)
        if item is None:
            work.pop()
            continue
        layer, plain = item
        if layer is None:
            unopened += 1
            continue
        if not layer.text:
            continue
        key = *layer.span(0, len(layer.text)), digest(layer.text)
        if key in seen:
            continue
        seen.add(key)
        inner = base_spans(layer.text)
        opened += plain or bool(inner)
        found.update((*layer.span(a, b), kind) for a, b, kind in inner)
        work.append(layers(layer))
    return base, sorted(found - set(base), key=lambda s: (s[0], KINDS.index(s[2]), s[1])), opened, unopened


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each stretch that spans cover replaced by the name of its first span's kind."""
    out, at, k = [], 0, 0
    spans = sorted(spans)
    while k < len(spans):
        a, b, kind = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < b:
            k += 1
            b = max(b, spans[k][1])
        out += [text[at:a], f"[{kind} removed]"]
        at, k = b, k + 1
    return "".join([*out, text[at:]])


FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, n_unopened long"


def _found(text: str) -> tuple:
    base, more, opened, unopened = scan(text)
    n = [sum(s[2] == k for s in base) for k in KINDS]
    both = sorted([*base, *more], key=lambda s: (s[0], KINDS.index(s[2]), s[1])) if more else base
    return *n, hashlib.sha256(written(base).encode()).hexdigest(), written(both), opened, unopened


def secret_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts, digest and spans of each row. One scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                cols = list(zip(*(_found(t or "") for t in part.column(1).to_pylist())))
                kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], [id_column, *(x.split()[0] for x in FOUND.split(", "))])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, F.col(text_column).alias("text")).mapInArrow(run, f"`{id_column}` {kind}, {FOUND}")


def without_secrets(docs: DataFrame, text_column: str = "text", length_column: str = "n_chars") -> DataFrame:
    """The same rows and columns; the secrets in the texts are replaced, and lengths follow. Texts without any stay as they are."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            t = t.as_py()
            spans = [] if t is None else [s for part in scan(t)[:2] for s in part]
            out.append(redacted(t, spans) if spans else t)
        return pa.array(out, pa.string())

    out = docs.withColumn(text_column, clean(F.col(text_column)))
    return out.withColumn(length_column, F.char_length(text_column).cast(docs.schema[length_column].dataType)) if length_column in docs.columns else out


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))
