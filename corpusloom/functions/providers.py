"""Providers of what needs a model: annotations, vectors, generated text. The defaults here are rules that run offline; they
don't equal the output of any particular tagger, encoder or generator.

A provider is registered by kind and name, and is a function of an iterator of Arrow arrays, so that a real one can load its
model once a task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

Provider = Callable[[Iterator[pa.Array]], Iterator[pa.Array]]
_REGISTRY: dict[tuple[str, str], tuple[Provider, str]] = {}


def register(kind: str, name: str, returns: str) -> Callable[[Provider], Provider]:
    def keep(f: Provider) -> Provider:
        _REGISTRY[kind, name] = f, returns
        return f

    return keep


#: Bytes of text that a provider gets at a time.
PART = 1 << 18


def parts(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of an array of texts by their bytes; a larger text is one of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PART, "right")))
        yield texts.slice(i, j - i)
        i = j


def provided(kind: str, name: str, text: Column) -> Column:
    """What a provider says of each text. It gets some texts at a time, `PART` bytes of them or a single one, since what it makes
    of them can be far larger."""
    f, returns = _REGISTRY[kind, name]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from f(part for texts in batches for part in parts(texts))

    return arrow_udf(run, returns)(text)


TOKENS = "array<struct<text:string,pos:string,is_stop:boolean,is_punct:boolean,idx:int>>"
#: Closed word classes; fixed values.
CLOSED = {w: p for p, ws in {
    "DET": "the a an this that these those each every some any no", "ADP": "of in on at by with from to for into upon about over under after before between through during without within against",
    "CCONJ": "and or but nor yet", "SCONJ": "because although though while if unless until since whereas", "PRON": "i you he she it we they me him her us them who whom which what myself himself itself",
    "AUX": "is are was were be been being am has have had do does did will would shall should can could may might must", "PART": "not n't",
}.items() for w in ws.split()}
_SUFFIXES = (("ly", "ADV"), ("ing", "VERB"), ("ed", "VERB"), ("ous", "ADJ"), ("ful", "ADJ"), ("ive", "ADJ"), ("able", "ADJ"), ("al", "ADJ"), ("ic", "ADJ"))


_TOKEN = re.compile(r"\w+(?:'\w+)?|[^\w\s]")
_CLASSES = sorted({"PUNCT", "NUM", "PROPN", "NOUN", *CLOSED.values(), *(p for _, p in _SUFFIXES)})


def _classes(w: str) -> tuple[str, str]:
    """A token's part of speech at the start of a sentence, and inside one: closed classes by list, numbers, capitalised words
    inside a sentence, endings."""
    low = w.lower()
    if not w[0].isalnum() and w[0] != "_":
        pos = "PUNCT"
    elif low in CLOSED:
        pos = CLOSED[low]
    elif w.isdigit():
        pos = "NUM"
    else:
        pos = next((p for e, p in _SUFFIXES if low.endswith(e) and len(low) > len(e) + 2), "NOUN")
        return pos, "PROPN" if w[0].isupper() else pos
    return pos, pos


class _Lexicon(dict):
    """Tokens by number, and what is known of each."""

    def __init__(self) -> None:
        self.facts: list[tuple[int, int, bool, bool]] = []

    def __missing__(self, w: str) -> int:
        self[w] = k = len(self.facts)
        first, inside = _classes(w)
        self.facts.append((_CLASSES.index(first), _CLASSES.index(inside), w.lower() in CLOSED, w in ".!?"))
        return k


@register("annotate", "rules", TOKENS)
def rules(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Tokens with a coarse part of speech; each distinct one of an array is looked at once."""
    for texts in batches:
        lexicon, of, idx, ends = _Lexicon(), [], [], [0]
        for t in texts.to_pylist():
            found = list(_TOKEN.finditer(t)) if t else ()
            of += [lexicon[m[0]] for m in found]
            idx += [m.start() for m in found]
            ends.append(len(of))
        k, facts = np.array(of, np.int64), np.array(lexicon.facts, np.int64).reshape(-1, 4)[of]
        starts = np.concatenate([[True], facts[:-1, 3] > 0])[: len(k)]
        starts[[i for i in ends if i < len(k)]] = True
        pos = np.where(starts, facts[:, 0], facts[:, 1])
        fields = [pa.array(list(lexicon), pa.string()).take(pa.array(k)), pa.array(_CLASSES, pa.string()).take(pa.array(pos)), pa.array(facts[:, 2] > 0), pa.array(facts[:, 1] == _CLASSES.index("PUNCT")), pa.array(idx, pa.int32())]
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["text", "pos", "is_stop", "is_punct", "idx"]))


def hashed_vector(text: str, size: int = 64) -> np.ndarray:
    """Signed counts of hashed runs of three characters, of length one."""
    import zlib

    v = np.zeros(size)
    low = f" {text.lower()} "
    for i in range(len(low) - 2):
        h = zlib.crc32(low[i : i + 3].encode())
        v[h % size] += 1 if h >> 31 else -1
    n = np.linalg.norm(v)
    return v / n if n else v


@register("encode", "hashing", "array<float>")
def hashing(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([hashed_vector(t or "").astype(np.float32) for t in texts.to_pylist()], pa.list_(pa.float32()))


@register("generate", "echo", "string")
def echo(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from batches


class Busy(Exception):
    """A provider that can't answer now: a rate limit or a timeout."""


def patient(call: Callable[[str], str], most: int = 5, first: float = 2.0, limit: float = 60.0, wait: Callable[[float], None] | None = None) -> Callable[[str], str | None]:
    """The call, tried again while it is `Busy`, `most` times in all, with pauses that double from `first` seconds up to
    `limit`; None if it stays so. Other errors aren't retried."""
    import time

    def run(text: str) -> str | None:
        pause = first
        for k in range(most):
            try:
                return call(text)
            except Busy:
                if k + 1 < most:
                    (wait or time.sleep)(pause)
                    pause = min(limit, 2 * pause)
        return None

    return run


def client(make: Callable[[], Callable[[str], str | None]]) -> Provider:
    """A provider of a call on one text; `make` opens it once a task. Null texts stay null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        call = make()
        for texts in batches:
            yield pa.array([None if t is None else call(t) for t in texts.to_pylist()], pa.string())

    return run


#: Which provider writes and which judges; both the echo by default.
ROLES = {"writer": "echo", "critic": "echo"}


def chat(system: str, history: list[tuple[str, str]], user: Column, role: str = "writer") -> Column:
    """The answer of a role's provider to a conversation: a system line, earlier (role, text) turns, and the user's text."""
    from pyspark.sql import functions as F

    turns = [F.lit(f"{who}: {said}") for who, said in [("system", system), *history]]
    return provided("generate", ROLES[role], F.concat_ws("\n", *turns, F.concat(F.lit("user: "), user)))


def verified(verify: Callable[[str, str], float], original: Column, output: Column) -> Column:
    """A function of original and output texts, as a column of scores; null where either is."""

    @arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else float(verify(x, y)) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())

    return run(original, output)


def overlap_logits(premise: str, claim: str) -> list[float]:
    """Logits of contradiction, neutral and entailment by shared words: an offline stand-in for a cross-encoder."""
    own, theirs = set(re.findall(r"\w+", premise.lower())), set(re.findall(r"\w+", claim.lower()))
    share = len(own & theirs) / len(theirs) if theirs else 1.0
    return [0.0, 2 * (1 - share), 4 * share]


def is_base_model(name: str) -> bool:
    """Whether a model's name is that of a base model, which isn't one that chats."""
    low = name.lower()
    return "base" in low or not any(x in low for x in ("instruct", "chat", "-it"))


#: How a generator runs unless its adapter says otherwise.
SETTINGS = {"temperature": 0.7, "top_p": 0.9, "max_tokens": 512, "repetition_penalty": 1.1}


def settings(adapter: dict | None) -> dict:
    """The settings of an adapter's record; what it lacks, or has of another type, is the default."""
    said = adapter if isinstance(adapter, dict) else {}
    return {k: type(v)(said[k]) if isinstance(said.get(k), (int, float)) and not isinstance(said.get(k), bool) else v for k, v in SETTINGS.items()}
