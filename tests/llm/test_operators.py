"""Each operator against a brute-force version, over texts of every odd kind."""

import base64
import collections
import gzip
import hashlib
import math
import random
import re
import zlib

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, extra string"


def odd_rows():
    r = random.Random(7)
    vocabulary = ["the", "of", "straße", "Éau", "naïve", "token", "x1", "日本", "a", "Z"] + [f"w{i}" for i in range(60)]
    long = " ".join(r.choice(vocabulary) for _ in range(3000))
    passage = " ".join(f"p{i}" for i in range(70))
    near = long.split()
    near[100] = "changed"
    texts = [None, "", " \n\t ", "one", "One two\x0bthree four", long, long, " ".join(near), passage, f"head {passage} tail", f"{passage} {passage}", "x" * 50_000, "ab" * 400, "ab" * 400 + "c", "é" * 120 + " end.", "<|endoftext|> it's I'll don't", "a\x1cb\x85c d"]
    texts += [" ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 60))) + r.choice([".", "!", "\n", ""]) for _ in range(40)]
    rows = [(i * 3, t, r.choice(["s1", "s2", "s1", None]), "en", len(t or ""), "e") for i, t in enumerate(texts)]
    return rows + [rows[5], (None, long, "s2", None, None, None), (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_token_counts_equal_the_library(spark, odd, none, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from corpusloom.llm.tokencount import CACHE, count_tokens

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    library = Tokenizer.from_file(path)
    docs = odd.union(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000", "text", "source", "lang", "n_chars", "''"))
    want = sorted(((r[0], len((r[1] or "").encode()), n := len(library.encode(r[1] or "", add_special_tokens=False).ids), n > 2048) for r in docs.select("doc_id", "text").collect()), key=repr)
    cache = f"file://{tmp_path}/cache"
    assert pairs(count_tokens(docs, path, cache), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    stored = spark.read.schema(CACHE).parquet(cache).count()
    assert stored == spark.read.schema(CACHE).parquet(cache).select("content").distinct().count() < docs.count()
    assert pairs(count_tokens(docs, path, cache), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert spark.read.schema(CACHE).parquet(cache).count() == stored  # nothing is encoded twice
    assert count_tokens(none, path, f"file://{tmp_path}/other").count() == 0


def test_plain_words_count_by_their_pieces(monkeypatch, tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    from corpusloom.llm import tokencount as tc

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    library, r = Tokenizer.from_file(path), random.Random(11)
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    visible = "".join(map(chr, range(0x21, 0x7F)))
    plain = [visible, "''s", "it's", "IT'S", ".'s", "'LL'll", "they'd've", "a1b22C333", "x" * 3000, "__init__", "``", "<|x|>", "</w>", "w</w>", "<|endoftext"]
    plain += ["".join(r.choice(visible + "'stremvlSTREMVL" * 3) for _ in range(r.randrange(1, 20))) for _ in range(2000)]
    odd = ["<|endoftext|>", "a<|endoftext|>'s", "<|startoftext|>B", "<|ENDOFTEXT|>", "e\u0301t\u00e9", "a\u0301", "x\u00a0y", "\u212aelvin", "\u017f's", "I\u0307", "\u03a3\u03a3", "a\x1cb", "a\x7fb", "\x00", "a\u2028b", "\u200d", "9\u0663", "e\u200b's"]
    counter = tc.Counter(path)
    assert counter.counts([w.encode() for w in odd]) == [size(w) for w in odd]
    encode = counter.encode
    monkeypatch.setattr(counter, "encode", lambda texts: pytest.fail(f"{texts[:3]} went to the library whole"))
    assert counter.counts([w.encode() for w in plain]) == [size(w) for w in plain]
    counter.encode = encode
    texts = [" \n".join(r.choice(plain + odd) for _ in range(50)) for _ in range(40)]
    for most in (1_000_000, 10):  # and with memos that start anew
        monkeypatch.setattr(tc, "MEMO_WORDS", most)
        assert [n for t in texts for n in counter.counts([t.encode()])] == counter.counts([t.encode() for t in texts]) == [size(t) for t in texts]
    spec = json.loads(open(path).read())
    spec["normalizer"]["normalizers"].pop()  # another tokenizer, which tells capitals apart
    (tmp_path / "other.json").write_text(json.dumps(spec))
    other, library = tc.Counter(str(tmp_path / "other.json")), Tokenizer.from_file(str(tmp_path / "other.json"))
    assert other.added is None and other.counts([w.encode() for w in plain]) == [size(w) for w in plain]
    # a worker's tasks share what they have learned
    assert tc.counter_of(path, b"1") is tc.counter_of(path, b"1") is not tc.counter_of(path, b"2")


def test_token_counts_of_pieces(spark, odd, tmp_path):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    from corpusloom.llm.tokencount import count_tokens

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    library = SentencePieceProcessor(model_file=path)
    want = sorted(((r[0], len(library.encode(r[1] or ""))) for r in odd.select("doc_id", "text").collect()), key=repr)
    assert pairs(count_tokens(odd, path, f"file://{tmp_path}/cache"), "doc_id", "n_tokens") == want


def test_context_mixing(spark, odd, none):
    from corpusloom.llm.contextmix import held_out, scored

    docs = odd.select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000", "text"))
    rows = [(r[0], re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode().lower())) for r in docs.collect()]
    counts, n = {}, 0
    for i, ws in rows:
        if not held_out(i):
            n += len(ws) + 1
            for w in [*ws, None]:
                counts[w] = counts.get(w, 0) + 1
    base = lambda w: math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (len(counts) + 1)))
    want = sorted(((i, held_out(i), len(ws) + 1, sum(w in counts for w in [*ws, None]), n, round(sum(map(base, [*ws, None])), 6)) for i, ws in rows), key=repr)
    got = scored(docs, chunk_bytes=50_000).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    held = [r for r in got if r.held_out and r.doc_id and r.doc_id >= 1000]
    bits = sum(-r.score for r in held) / sum(r.n_tokens for r in held)
    assert bits < sum(-r.base_score for r in held) / sum(r.n_tokens for r in held) + 0.3  # base: no distribution over strings
    assert 0 < sum(r.bits_per_byte for r in held) / len(held) < 3.5  # bytes drawn evenly from the texts' letters have over 4
    assert scored(none.select("doc_id", "text")).count() == 0


def test_context_mixing_follows_the_text(spark):
    from corpusloom.llm.contextmix import scored

    r = random.Random(6)
    vocabulary = [f"word{i}" for i in range(300)]
    phrases = [[r.choice(vocabulary) for _ in range(6)] for _ in range(40)]
    texts = [" ".join(w for _ in range(30) for w in (r.choice(phrases[k % 7 : k % 7 + 5]) if r.random() < 0.7 else [r.choice(vocabulary)])) for k in range(150)]
    rows = [(3 * i, t) for i, t in enumerate(texts)] + [(3 * i + 1_000_000, " ".join(t.split()[::-1])) for i, t in enumerate(texts)]
    shuffled = [r.sample(t.split(), len(t.split())) for t in texts]
    rows += [(3 * i + 2_000_000, " ".join(t)) for i, t in enumerate(shuffled)] + [(7, "again " * 5000), (8, " ".join(f"x{i}" for i in range(3000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in scored(docs, chunk_bytes=30_000).collect()}
    same = {x.doc_id: x.score for x in scored(docs.repartition(3), chunk_bytes=30_000).collect()}
    assert all(abs(got[i].score - same[i]) < 1e-6 * abs(same[i]) for i in same)  # whatever chunk a text is in
    ids = [3 * i for i in range(150)]
    assert all(abs(got[i].score - got[i + 1_000_000].score) > 1e-6 for i in ids)  # the order of words counts
    mean = lambda add: sum(got[i + add].score for i in ids if got[i].held_out) / sum(got[i].held_out for i in ids)
    assert mean(0) > 1.25 * mean(2_000_000)  # text that repeats its phrases is likelier than the same words in disorder
    base = sum(got[i].base_score for i in ids if got[i].held_out) / sum(got[i].held_out for i in ids)
    assert mean(0) > 0.75 * base
    assert got[7].score > 0.2 * got[7].base_score


def test_running_bits_equal_a_slow_version():
    import numpy as np

    from corpusloom.llm import contextmix as cm

    r = random.Random(8)
    texts = [[r.randrange(12) for _ in range(n)] for n in (0, 1, 5, 40, 700, 3)]
    sizes = np.array([r.randrange(1, 12) for _ in range(12)])
    first = np.cumsum([0, *map(len, texts)])
    of = np.array([w for t in texts for w in t])
    course = cm.Course(of, first, sizes)
    counts = course.counts(np.array([False, True, False, False, False, False]))
    flow = cm.Flow(counts, 0.1)
    known = np.array([r.random() < 0.8 for _ in range(13)])
    known = known[np.minimum(course.word, 12)]
    logs = flow.logs(course, known)
    odds = lambda n1, n0: math.log((n1 + 0.4) / (n0 + 0.4))
    slot = lambda k, c: int(cm.mix(np.array([c + 1000 * k], np.uint64))[0] >> np.uint64(56))
    table, told = {}, []
    for d, t in enumerate(texts):
        past, outcomes, rows = [], [], []
        for i, w in enumerate([*t, "end"]):
            level, guess = 0, None
            for n in (2, 1):  # the longest context that the text had before
                hits = [j for j in range(n, i) if past[j - n : j] == past[i - n : i]] if i >= n else []
                if hits:
                    level, guess = n, past[hits[-1]]
                    break
            follows, again = guess is not None and guess == w, w in past
            back = [outcomes[-k] if i >= k else 3 for k in (1, 2, 3)]
            length = min(sizes[past[-1]], 7) if i else 0
            raw = [level * 64 + back[0] * 16 + back[1] * 4 + back[2], (level * 8 + length) * 4 + back[0], (min(int(math.log2(i + 1)), 15) * 3 + level) * 4 + back[0]]
            bits = [(0, follows)] if level else []
            if not follows and i:
                bits.append((1, again))
            if d != 1:
                for f, b in bits:
                    for k in range(3):
                        table.setdefault((f, k, slot(k, raw[k])), [0, 0])[b] += 1
            rows.append((level, [slot(k, raw[k]) for k in range(3)], bits, not follows and not again))
            outcomes.append(2 if follows else 1 if again else 0)
            past.append(w)
        told.append(rows)
    assert sum(map(sum, table.values())) == counts.sum()
    at = 0
    for rows in told:
        for i, (level, slots, bits, last) in enumerate(rows):
            if i % cm.SEGMENT == 0:
                weights = {(f, g): [0.4, 0.3, 0.2, 0.1] for f in range(3) for g in range(3)}
                refine = {f: [1 / (1 + math.exp(-m)) for m in cm._MIDDLES] for f in range(3)}
                own = {f: [0.4, 0.4] for f in range(3)}
            total = 0.0
            for f, b in [*bits, *([(2, bool(known[at]))] if last else [])]:
                x = [odds(0.9 - 0.4, 0.1 - 0.4)] * 3 if f == 2 else [odds(*table.get((f, k, slots[k]), [0, 0])[::-1]) for k in range(3)]
                x.append(math.log(own[f][1] / own[f][0]))
                s = min(8, max(-8, sum(p * q for p, q in zip(weights[f, level], x))))
                p = 1 / (1 + math.exp(-s))
                cell = (s + 8) * 16 / 16
                low = min(int(cell), cm.CELLS - 2)
                part = cell - low
                q = min(1 - 1e-5, max(1e-5, (p + refine[f][low] * (1 - part) + refine[f][low + 1] * part) / 2))
                total += math.log10(q if b else 1 - q)
                weights[f, level] = [v + cm.RATE * (b - p) * y for v, y in zip(weights[f, level], x)]
                refine[f][low] += cm.REFINED * (1 - part) * (b - refine[f][low])
                refine[f][low + 1] += cm.REFINED * part * (b - refine[f][low + 1])
                own[f][b] += 1
            assert abs(total - logs[at]) < 2e-3, (at, total, logs[at])
            at += 1


def test_repeated_words_are_told_by_mixed_bits(monkeypatch):
    import numpy as np

    from corpusloom.llm import contextmix as cm

    r = random.Random(9)
    texts = [[r.randrange(40) for _ in range(n)] for n in (0, 1, 2, 30, 600, 5)]

    def coded(texts):
        course = cm.Course(np.array([w for t in texts for w in t]), np.cumsum([0, *map(len, texts)]), np.full(40, 5))
        return course, cm.Recall(course).logs()

    course, logs = coded(texts)
    at = 0
    for t in texts:
        number, past = {}, []
        for i, w in enumerate(t):
            if i % cm.SEGMENT == 0:
                weights, own = {}, {}
            total = 0.0
            for h in range(8, -1, -1) if w in number and not course.bits[cm.FOLLOWS][at + i] else ():
                high = number[w] >> (h + 1)
                sides = [number[v] >> h & 1 for v in past if number[v] >> (h + 1) == high]
                if 0 < sum(sides) < len(sides):
                    right = min(len(number) - (high * 2 + 1 << h), 1 << h)
                    o, ws, b = own.setdefault(h, [0.4, 0.4]), weights.setdefault(h, list(cm.Recall.WEIGHTS)), number[w] >> h & 1
                    odds = lambda n1, n0: math.log((n1 + 0.4) / (n0 + 0.4))
                    x = [odds(sum(sides), len(sides) - sum(sides)), odds(right, 1 << h), 2 * sides[-1] - 1, math.log(o[1] / o[0])]
                    p = 1 / (1 + math.exp(-min(8, max(-8, sum(u * v for u, v in zip(ws, x))))))
                    total += math.log10(p if b else 1 - p)
                    weights[h] = [u + cm.RATE * (b - p) * v for u, v in zip(ws, x)]
                    o[b] += 1
            assert abs(total - logs[at + i]) < 1e-4, (at, i)
            number.setdefault(w, len(number))
            past.append(w)
        at += len(t) + 1
    assert (coded([texts[4][:300]])[1][:300] == coded([texts[4]])[1][:300]).all()  # whatever comes later
    monkeypatch.setattr(cm.Recall, "TOKENS", 20)
    assert (cm.Recall.all_logs(course) == logs).all()


def test_choices_among_training_words_are_a_distribution():
    import numpy as np

    from corpusloom.llm import contextmix as cm

    words = [b"a", b"ab", b"abba", b"b", b"ba", "日本".encode(), b"zebra"]
    counts = np.array([50, 3, 1, 20, 2, 1, 9])
    spelled = cm.Spelled(np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)]))
    tables, mixer = cm.empty_tables(), cm.chooser()
    cm.count_bits(tables, spelled, counts)
    cm.count_bits(tables, cm._end(), np.array([4]))

    def sums():
        out = []
        for x in (spelled, cm._end()):
            pairs, found, of = tables.looked_up(x)
            out += cm.Forks(x, of, cm.Forks.parting(found), *cm.odds(pairs, found, False), np.arange(len(x.flat))).logs(mixer, x.word[-1] + 1).tolist()
        return out

    plain = sums()
    assert abs(sum(10**v for v in plain) - 1) < 1e-9 and abs(10 ** plain[0] - 50 / 90) < 0.05  # at first, by frequency
    pairs, found, of = tables.looked_up(spelled)
    forks = cm.Forks(spelled, of, cm.Forks.parting(found), *cm.odds(pairs, found, True), np.arange(len(spelled.flat)))
    for _ in range(10):
        mixer.step(forks.x, forks.level, forks.place, forks.bit, counts[forks.word].astype(float))
    assert abs(sum(10**v for v in sums()) - 1) < 1e-9 and sums() != plain


def test_context_mixing_is_a_distribution():
    import numpy as np

    from corpusloom.llm.contextmix import CLOSE, Mixer, Spelled, count_bits, empty_tables

    words = [b"ab", b"b", b"abba"] * 5
    data, at = np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)])
    tables, mixer = empty_tables(), Mixer()
    spelled = Spelled(data, at)
    count_bits(tables, spelled, np.ones(len(words), np.int64))
    for _ in range(20):
        mixer.learn(tables.looked_up(spelled), spelled, np.ones(len(words), np.int64))
    first = np.arange(256, dtype=np.uint8)  # one byte and nothing else: its bits' probabilities sum to one
    one = Spelled(np.zeros(0, np.uint8), np.zeros(257, np.int64))
    one.flat = first
    assert abs((10 ** mixer.score(tables.looked_up(one), one, 256)).sum() - 1) < 1e-9
    both = Spelled(*[np.frombuffer(b"abxy", np.uint8), np.array([0, 2, 4])])
    known, unknown = mixer.score(tables.looked_up(both), both, 2)
    assert known > unknown + 2 and CLOSE == 0x20


def brute_windows(docs, items, window=10):
    find = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    out = []
    for i, t in docs:
        ws, hit, found = find(t), set(), set()
        for item, text in items:
            v = find(text)
            for a in range(max(1, len(v) - window + 1) if v else 0):
                x = v[a : a + window]
                for p in range(len(ws) - len(x) + 1):
                    if ws[p : p + len(x)] == x:
                        hit.update(range(p, p + len(x)))
                        found.add(str(item))
        out.append((i, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [8 << 20, 200])
def test_decontamination(spark, odd, none, block_bytes):
    from corpusloom.llm.decontam import decontaminated, matched

    items = [(1, " ".join(f"p{i}" for i in range(20, 45))), (10, "One two, three"), (2, ""), (3, None), (4, "..."), (5, "日本 日本 " * 9), (6, "the of"), (1, "w1 w2 w3"), (7, " ".join(f"P{i}" for i in range(60, 70)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    docs = [(r[0], r[1]) for r in odd.select("doc_id", "text").collect()]
    got = pairs(matched(odd, bench, ["doc_id"], block_bytes=block_bytes), *cols)
    want = brute_windows(docs, items)
    assert got == want and any(r[5] for r in want) and not all(r[5] for r in want)
    clean = decontaminated(odd, bench)
    assert clean.columns == odd.columns and clean.count() == sum(not r[5] for r in want)
    assert matched(none, bench, ["doc_id"]).count() == 0
    clash = odd.select("*", *(odd.extra.alias(c) for c in ("contaminated", "found", "own_0", "n_words", "items")))
    assert decontaminated(clash, bench).columns == clash.columns and decontaminated(clash, bench).count() == clean.count()
    assert pairs(matched(clash, bench, clash.columns), *cols) == want
    assert not any(r[5] for r in pairs(matched(odd, bench.limit(0), ["doc_id"]), *cols))


@pytest.mark.parametrize(("n", "k", "most"), [(400, 4, 6), (600, 3, 60), (90, 2, 90)])
def test_suffix_search_gives_the_longest_match(n, k, most):
    import numpy as np

    from corpusloom.llm.decontam import Suffixes, search

    r = np.random.default_rng(n)
    numbers, texts = r.integers(0, k, n), np.arange(n) // 50
    numbers[n // 2 :] = numbers[: n - n // 2]  # long repeats
    left = np.array([(texts == t).sum() - (i - np.flatnonzero(texts == t)[0]) for i, t in enumerate(texts)])
    suffixes = Suffixes(numbers, left, most)
    words_of = lambda i: tuple(numbers[i : i + suffixes.depth[i]][:most])
    assert [words_of(i) for i in suffixes.order] == sorted(words_of(i) for i in range(n) if numbers[i])
    asked = r.integers(1, k, 200)
    queries = Suffixes(asked, np.array([40 - i % 40 for i in range(200)]), 40)
    sizes = np.minimum(r.integers(1, 7, 200), queries.depth)
    begin, end, longest, lo, hi = search(suffixes, queries, np.arange(200), sizes)
    for q in range(200):
        fits = lambda m: {p for p in range(n) if suffixes.depth[p] >= m and (numbers[p : p + m] == asked[q : q + m]).all()}  # noqa: B023, E731
        assert longest[q] == max([m for m in range(1, queries.depth[q] + 1) if fits(m)], default=0)
        assert set(suffixes.order[begin[q] : end[q]]) == fits(sizes[q])
        assert not longest[q] or set(suffixes.order[lo[q] : hi[q]]) == fits(longest[q])


def test_longest_matches_and_their_places(spark, none):
    from corpusloom.llm.decontam import longest_matches, matched

    r = random.Random(2)
    items = [(i, " ".join(f"v{r.randrange(9)}" for _ in range(r.randrange(0, 40)))) for i in range(12)] + [(50, None)]
    texts = []
    for i in range(40):
        own = [f"v{r.randrange(9)}" for _ in range(r.randrange(0, 30))]
        for _ in range(r.randrange(3)):
            v = (items[r.randrange(12)][1]).split()
            a = r.randrange(len(v) + 1)
            own[r.randrange(len(own) + 1) :] = v[a : a + r.randrange(20)]
        texts.append((None if i == 7 else i // 2 * 2, " ".join(own)))
    texts += [(100, " ".join([*(f"x{i}" for i in range(10)), *(f"y{i}" for i in range(10))]))]
    items += [(60, " ".join(f"x{i}" for i in range(10))), (61, " ".join(f"y{i}" for i in range(10)))]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")

    def common(v, w):
        return next((k for k, (x, y) in enumerate(zip(v, w)) if x != y), min(len(v), len(w)))

    want, own = [], {}
    for item, text in items:
        v = (text or "").split()
        for a in range(len(v)):
            found = [(common(v[a:], t.split()[p:]), d, p) for d, t in texts for p in range(len(t.split()))]
            best = max((f[0] for f in found), default=0)
            if best >= 10:
                _, d, p = min((f for f in found if f[0] == best), key=lambda f: (f[1] is None, f[1] or 0, f[2]))
                want.append((str(item), a, best, d, p))
    assert pairs(longest_matches(docs, bench), "item_id", "suffix", "n_words", "doc_id", "start") == sorted(want, key=repr) and want
    assert pairs(longest_matches(docs, bench, block_bytes=100), "item_id", "suffix", "n_words", "doc_id", "start") == sorted(want, key=repr)
    for r_ in matched(docs, bench, ["doc_id", "text"]).collect():
        v = r_.text.split()
        best = max((common(v[a:], (t or "").split()[p:]) for _, t in items for p in range(len((t or "").split())) for a in range(len(v))), default=0)
        short = [len((t or "").split()) for _, t in items if 0 < len((t or "").split()) < 10]
        if best >= 10:
            assert r_.longest_match == best
        elif not short:
            assert r_.longest_match == 0
    assert [x.longest_match for x in matched(docs, bench, ["doc_id"]).where("doc_id = 100").collect()] == [10]  # two items side by side are two matches
    assert longest_matches(none, bench).count() == longest_matches(docs, bench.limit(0)).count() == 0


def test_items_that_share_windows():
    import numpy as np

    from corpusloom.llm import decontam

    group, texts = np.repeat(np.arange(50), 20), np.tile(np.arange(20), 50)
    item_group, items = np.repeat(np.arange(50), 30), np.tile(np.arange(30), 50)
    was = decontam.PAIRS
    for decontam.PAIRS in (1, 700, was):
        assert len(decontam._pairs(group, texts, item_group, items, 30)) == 600
    assert decontam._pairs(np.array([1]), np.array([4]), np.array([0, 1, 1]), np.array([9, 2, 5]), 10).tolist() == [42, 45]


def brute_repeats(rows, length):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode())):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("length", "period", "chunk_bytes"), [(100, 57, 30_000), (40, 31, 8 << 20), (100, 31, 4 << 20)])
def test_suffix_dedup(spark, odd, none, length, period, chunk_bytes):
    from corpusloom.llm.suffixdedup import without_repeats

    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    rows = [(r[0], r[1]) for r in odd.select("doc_id", "text").collect()]
    assert pairs(without_repeats(odd, length, period, chunk_bytes), *cols) == brute_repeats(rows, length)
    assert without_repeats(none).count() == 0


def test_suffix_buckets_decide_by_bytes(monkeypatch):
    """Colliding hashes, small blocks, ties of all depths and every residue: what is removed is what a set of strings says."""
    import numpy as np

    from corpusloom.llm import suffixdedup as sd
    from corpusloom.llm.exchange import squeezed

    r, plain = random.Random(1), sd.window_hashes
    spans = sd.span_hashes

    def text():
        k = r.randrange(6)
        if k < 3:
            return [b"x" * r.randrange(600), b"ab" * r.randrange(300), bytes(r.choice(b"ab") for _ in range(r.randrange(300))) * r.randrange(1, 3)][k]
        if k == 3:
            return b"0123456789abcdefghijklmnopqrstu"[: r.randrange(5, 31)] * r.randrange(20)
        return b" ".join(r.choice([b"the", b"quick", b"brown", b"fox", b"jumps", b"%d" % r.randrange(5)]) for _ in range(r.randrange(90)))

    for trial in range(40):
        monkeypatch.setattr(sd, "ROUNDS", r.choice([0, 1, 4]))
        monkeypatch.setattr(sd, "BLOCK_BITS", r.choice([18, 11, 16]))
        weak = lambda f: (lambda *a: f(*a) & np.uint64(3 << 60 | 1)) if trial % 3 == 0 else f  # noqa: B023, E731
        monkeypatch.setattr(sd, "window_hashes", weak(plain))
        monkeypatch.setattr(sd, "span_hashes", weak(spans))
        docs = [text() for _ in range(12)]
        docs += [docs[r.randrange(12)][r.randrange(50) :] + text() for _ in range(8)]
        length, period = r.choice([(100, 31), (40, 13), (100, 50), (30, 7), (64, 31), (100, 57)])
        buckets, per, chunks, sent = r.choice([1, 3, 7]), r.choice([1, 4, 30]), [], {}
        for c in range(0, len(docs), per):
            d = docs[c : c + per]
            chunks.append(sd.Chunk(squeezed(np.zeros(len(d), bool), np.arange(c, c + len(d)), np.zeros(len(d), "<u4"), np.cumsum([0, *map(len, d)]), np.frombuffer(b"".join(d), np.uint8)), length, min(28, length)))
        told = [{} for _ in chunks]
        for i, c in enumerate(chunks):
            for k, runs in c.sent(buckets):
                sent.setdefault(k, []).append((i, c.blob(runs)))
        for k, parts in sent.items():
            for (i, _), bits in zip(parts, sd.sorted_bucket(parts, length, sd.Cover(period))):
                told[i][k] = bits
        got = b"".join(c.gone(t, buckets).astype(np.uint8).tobytes() for c, t in zip(chunks, told))
        seen, want = set(), []
        for b in docs:
            gone = bytearray(len(b))
            for p in range(len(b) - length + 1):
                if b[p : p + length] in seen:
                    gone[p : p + length] = b"\1" * length
                seen.add(b[p : p + length])
            want.append(bytes(gone))
        assert got == b"".join(want), (trial, length, period, buckets, per)


def test_suffix_runs_are_found_once_a_chunk(spark, odd, monkeypatch):
    """What later steps need of a chunk's runs is stored with it; they hash no text again."""
    import numpy as np

    from corpusloom.llm import suffixdedup as sd
    from corpusloom.llm.bytetext import gather_spans, span_places

    rows = [(r.chunk, bytes(r.blob), bytes(r.runs)) for r in sd.dealt_chunks(odd, 30_000, 100, 28, "doc_id", "text").collect()]
    plain = [sd.Chunk(blob, 100, 28) for _, blob, _ in rows]
    for name in ("window_hashes", "span_hashes", "prefix_hashes"):
        monkeypatch.setattr(sd, name, lambda *a: pytest.fail("hashed again"))
    for want, (_, blob, runs) in zip(plain, rows):
        got = sd.Chunk(blob, 100, 28, runs)
        for k in ("null", "ids", "tie", "at", "data", "starts", "ends", "key", "multi", "of"):
            assert np.array_equal(getattr(got, k), getattr(want, k)), k
        assert got.found() == runs
    assert sum((c.of != np.arange(len(c.of))).sum() for c in plain) and sum(c.multi.sum() for c in plain)
    begin, end = np.array([5, 2, 2, 9]), np.array([7, 2, 5, 10])
    assert span_places(begin, end).tolist() == [5, 6, 2, 3, 4, 9] and gather_spans(np.arange(10) * 2, begin, end).tolist() == [10, 12, 4, 6, 8, 18]
    assert span_places(begin[:0], end[:0]).tolist() == []


def test_difference_covers():
    from corpusloom.llm.suffixdedup import difference_cover

    for v, n in ((7, 3), (13, 4), (31, 6), (57, 8), (20, 8), (64, 14)):
        d = difference_cover(v)
        assert len(d) <= n and {(a - b) % v for a in d for b in d} == set(range(v))


def test_fixity_audit_finds_what_was_damaged(spark, none):
    from pyspark.sql import functions as F

    from corpusloom.llm.fixity import audit, leaves, record, tree

    rows = [(i, f"http://h/{i}", "body " * (i % 40)) for i in range(0, 3000, 2)] + [(None, None, None), (None, "n", "y"), (4, "again", "x"), (4, "again", "x"), ((1 << 62) + 5, "far", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)

    def replica(pages):
        rec = record(F.col("page_id"), F.col("url"), F.col("html"))
        index = leaves(pages.select("page_id", F.octet_length(rec).cast("long").alias("size"), F.sha2(rec, 256).alias("digest"))).cache()
        return index, tree(index)

    def found(other):
        return sorted((r.page_id for r in audit(whole[1], other[1]).join(whole[0].union(other[0]).select("file", "idx", "page_id").distinct(), ["file", "idx"]).select("page_id").collect()), key=lambda x: (x is None, x))

    whole = replica(pages)
    assert whole[1][-1][1].count() == 1 and 4 <= len(whole[1]) <= 8 and found(whole) == []
    bad = F.col("page_id").isin(0, 512, 1000, 2998)
    longer = replica(pages.withColumn("html", F.when(bad, F.concat("html", F.lit("!"))).otherwise(F.col("html"))))
    assert found(longer) == [0, 512, 1000, 2998]
    assert whole[0].alias("a").join(longer[0].alias("b"), ["file", "idx"]).where("a.start <> b.start").count() > 100  # what follows has moved, and isn't reported
    lost = pages.where("page_id is null or page_id not in (6, 2998, 4611686018427387909)").union(spark.createDataFrame([(7, "new", "p" * 3_000_000)], pages.schema))
    assert found(replica(lost)) == [6, 7, 2998, (1 << 62) + 5]
    assert found(replica(pages.where("page_id is not null and not url <=> 'again'").union(spark.createDataFrame([(4, "again", "x")], pages.schema)))) == [4, None, None]  # one copy of two
    empty = tree(whole[0].limit(0))
    assert audit(empty, empty).count() == 0 and audit(whole[1], empty).count() == whole[0].count()


def test_warc_files(spark, tmp_path):
    from pyspark.sql import functions as F

    from corpusloom.llm.fixity import audit_files, read_warcs, record

    rows = [(i, f"http://h/{i}", "é body\r\n\r\nWARC/1.1 in it " * (i % 7)) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = [r[1].encode() for r in sorted(pages.select("page_id", record(F.col("page_id"), F.col("url"), F.col("html"))).collect())]
    for name, change in (("a", {}), ("b", {3: texts[3].replace(b"body", b"b0dy"), 30: b""})):
        (tmp_path / name).mkdir()
        own = [change.get(i, t) for i, t in enumerate(texts)]
        (tmp_path / name / "one.warc").write_bytes(b"".join(own[:20]))
        (tmp_path / name / "two.warc.gz").write_bytes(b"".join(gzip.compress(t) for t in own[20:] if t))
    got = read_warcs(spark, f"file://{tmp_path}/a").orderBy("name", "start").collect()
    assert [(r.uri, bytes(r.payload).decode(), r.digest) for r in got] == [(u, h, hashlib.sha256(t).hexdigest()) for (_, u, h), t in zip(rows, texts)]
    assert all(r.kind == "resource" and r.date.endswith("Z") for r in got) and got[1].start == len(texts[0]) == got[0].size
    whole = (tmp_path / "a" / "two.warc.gz").read_bytes()
    assert all(gzip.decompress(whole[r.start : r.start + r.size]) == t for r, t in zip(got[20:], texts[20:]))
    assert sorted((r.record_id, r.other_digest is None) for r in audit_files(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/b").collect()) == [("<urn:page:30>", True), ("<urn:page:3>", False)]
    (tmp_path / "b" / "one.warc").write_bytes(b"junk" + texts[0][:50])
    assert read_warcs(spark, f"file://{tmp_path}/b/one.warc").count() == 1


def test_secret_layers():
    from corpusloom.llm.secrets import redacted, scan, written

    key = "AKIA" + "A1B2C3D4E5F6G7H8"
    plain = f'password: hunter22 token=ab Passwd="abcdef" {key} {"0a" * 12} api-key=nothing1 API_KEY = k3yk3yk3y'
    base, more, *_ = scan(plain)
    assert written(base).count("assign") == 3 and written(base).count("access") == 1 and written(base).count("hex") == 1 and not more
    assert scan("password: token: abcdefgh")[0] == []  # the failing match takes the second name with it
    inner = f"secret={key}".encode()
    wrapped = base64.b64encode(gzip.compress(base64.b64encode(b"text with " + inner))).decode()
    text = f"see {wrapped} there"
    base, more, opened, _ = scan(text)
    assert {k for _, _, k in more} == {"assign", "access"} and all(text[a:b] == wrapped for a, b, _ in more) and opened == 2
    for code in ("".join(f"%{b:02X}" for b in inner), "".join(f"\\u{b:04x}" for b in inner), base64.urlsafe_b64encode(zlib.compress(inner)).decode()):
        _, more, *_ = scan(f"é {code} z")
        own = 2 + len(code) if code[0] not in "%\\" else 2 + len(code) // len(inner) * len(b"secret=")
        assert {(a, b, k) for a, b, k in more} == {(2, 2 + len(code), "assign"), (own if own < 2 + len(code) else 2, 2 + len(code), "access")}
    for text, want in [
        ("password = hunt%65r2222 x", {(0, 23, "assign")}),
        ("p%61ssword = hunter2222", {(0, 23, "assign")}),
        ("http://h/a/b/c?x=1&y=%20&z=1&token=abcdef99%21&foo=bar", set()),
        ("é%C3%A9 secret%3Dabc%2541ef go", {(8, 27, "assign")}),
        ("a \\u0073ecret: \\u0061bcde\\x66\\u005cu0067.", {(2, 41, "assign")}),
        ("\\ud83d\\ude00 token=ab\\u0063def", {(13, 30, "assign")}),
        ("token=abc%25252Bdef and %zz", {(0, 19, "assign")}),
        (f"k %74oken%3D{base64.b64encode(b'x: ' + inner).decode()}", None),
    ]:
        more = scan(text)[1]
        assert want is None or set(more) == want, (text, more)
        if want is None:
            assert {k for _, _, k in more} == {"assign", "access"}
        assert scan(redacted(text, [s for x in scan(text)[:2] for s in x]))[1] == []
    assert scan("%" + "25" * 50_000 + "41")[2] == 1 and scan("\\" + "u005c" * 20_000 + "u0041")[2] == 1  # at once, not layer by layer
    bomb = base64.b64encode(gzip.compress(b"\0" * (65 << 20))).decode()
    assert scan(bomb)[3] == 1
    assert scan("%25" * 2000)[2] >= 1  # ends
    assert key not in redacted(plain, scan(plain)[0]) and redacted("plain", []) == "plain"


def test_secret_scans(spark, odd, none):
    from corpusloom.llm.secrets import KINDS, base_spans, secret_spans, without_secrets, written

    docs = odd.select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000", "text"))

    def direct(t):
        out = [(m.start(), m.end(), "assign") for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A) if len(m[2]) >= 6]
        out += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        return sorted(out + [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24], key=lambda s: (s[0], KINDS.index(s[2])))

    rows = docs.collect()
    told = [(r[0], direct(r[1] or "")) for r in rows]
    want = sorted(((i, *[sum(s[2] == k for s in d) for k in KINDS], hashlib.sha256(written(d).encode()).hexdigest()) for i, d in told), key=repr)
    assert pairs(secret_spans(docs), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want
    assert sum(r[1] + r[2] + r[3] for r in want) > 0
    clean = without_secrets(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    assert not any(base_spans(r[0] or "") for r in without_secrets(docs).select("text").collect())
    assert secret_spans(none).count() == 0 and without_secrets(none).count() == 0


def test_quality_on_held_out_ratings(spark, odd, none):
    from corpusloom.llm.ordinal import fitted, good_documents, graded

    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fit, held = labels.where("doc_id % 3 > 0"), labels.where("doc_id % 3 = 0")
    rows = graded(docs.join(held.select("doc_id"), "doc_id", "left_semi"), fitted(docs, fit), ["doc_id"]).join(held, "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.toxic]
    toxic = [r for r in rows if r.toxic]
    poor = [r for r in rows if not r.quality and not r.toxic]
    assert sum(r.kept for r in good) >= 0.985 * len(good)
    assert sum(r.kept for r in toxic) <= 0.03 * len(toxic)
    assert sum(r.kept for r in poor) <= 0.1 * len(poor)
    mean = lambda x: sum(r.expected_grade for r in x) / len(x)
    assert mean(toxic) < mean(poor) < mean(good)
    assert graded(odd, None, ["doc_id"]).where("kept").count() == odd.count()
    clash = odd.select("*", *(odd.extra.alias(c) for c in ("kept", "g", "expected_grade", "own_0")))
    rated = spark.createDataFrame([(3 * i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(50)], "doc_id long, quality int, toxic int")
    model = fitted(odd.union(odd), rated)  # a repeated id is one rated document
    scores = graded(clash, model, clash.columns)
    assert sorted(scores.columns) == sorted({*clash.columns, "tail_probability"}) and scores.where("tail_probability is null").count() == 0
    by_text = {}
    for r in scores.collect():
        assert by_text.setdefault(r.text or "", r.tail_probability) == r.tail_probability and 0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2
    assert good_documents(clash, rated).columns == clash.columns and good_documents(clash, rated).count() == scores.where("kept").count()
    few = spark.createDataFrame([(15, 1, 0), (18, None, 0), (21, 0, None), (None, 1, 1), (999999, 1, 1)], "doc_id long, quality int, toxic int")
    assert good_documents(odd, few).columns == odd.columns
    assert good_documents(none, labels).count() == 0


def test_ordinal_regression_against_its_definition():
    import numpy as np

    from corpusloom.llm.ordinal import Ordinal, features, loss, thresholds

    r = np.random.default_rng(1)
    n, m = 30, 8
    texts, cols, grades, own = np.repeat(np.arange(n), 3), r.integers(0, m, 3 * n), r.integers(0, 4, n), r.random(n) + 0.5
    w, theta = r.normal(size=m), np.array([-0.7, 0.1, -0.4])

    def slow(w, theta):  # P(grade <= k) is logistic in cut k minus the score
        cuts = [theta[0], theta[0] + math.exp(theta[1]), theta[0] + math.exp(theta[1]) + math.exp(theta[2])]
        total = 0.0
        for i in range(n):
            s = sum(w[c] for t, c in zip(texts, cols) if t == i)
            up = [0.0, *(1 / (1 + math.exp(s - c)) for c in cuts), 1.0]
            total -= own[i] * math.log(up[grades[i] + 1] - up[grades[i]])
        return total / n + 0.01 * sum(x * x for x in w) / 200

    value, g_w, g_theta = loss(w, theta, texts, cols, grades, own, 0.01)
    assert value == pytest.approx(slow(w, theta), rel=1e-9)
    for g, x in ((g_w, w), (g_theta, theta)):
        for k in range(len(x)):
            up, down = x.copy(), x.copy()
            up[k] += 1e-5
            down[k] -= 1e-5
            near = (slow(up, theta) - slow(down, theta)) if x is w else (slow(w, up) - slow(w, down))
            assert g[k] == pytest.approx(near / 2e-5, abs=1e-6)
    model = Ordinal(r.normal(size=1 << 18) / 9, thresholds(theta))
    raw = [b"some words here", b"", b"words words and Words " * 50]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    of, dims = features(data, at)
    tails = model.tails(data, at)
    for i in range(3):
        s = float(sum(model.weights[d] for t, d in zip(of, dims) if t == i))
        assert tails[i] == pytest.approx([1 - 1 / (1 + math.exp(s - c)) for c in model.cuts], abs=1e-5)
    assert (np.diff(model.cuts) > 0).all() and (np.diff(tails, axis=1) < 0).all()
    # fitted on separable grades, it tells them apart
    grades = np.arange(60) % 3
    fit = Ordinal.fit(np.repeat(np.arange(60), 2), np.stack([grades + 5, np.full(60, 99)], axis=1).reshape(-1), grades, 3)
    s = fit.weights[[5, 6, 7]]
    assert s[0] < fit.cuts[0] < s[1] < fit.cuts[1] < s[2]


def test_the_fit_copies_features_once(spark, monkeypatch):
    """The driver holds them beside its JVM: 8 bytes a feature, and little more while it counts."""
    import tracemalloc

    import numpy as np

    from corpusloom.llm.ordinal import Ordinal, fitted

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    given, fit = [], Ordinal.fit
    monkeypatch.setattr(Ordinal, "fit", lambda texts, dims, *a: given.append((texts, dims)) or fit(texts, dims, *a))
    fitted(docs, labels)
    texts, dims = given[0]
    assert len(texts) == len(dims) > 10_000 and (np.diff(texts) >= 0).all() and texts.nbytes + dims.nbytes <= 8 * len(dims)
    r, n = np.random.default_rng(2), 3_000_000
    texts, dims, grades = np.sort(r.integers(0, 5000, n)).astype(np.int32), r.integers(1000, 1 << 18, n).astype(np.int32), r.integers(0, 3, 5000)
    dims[np.searchsorted(texts, np.flatnonzero(grades == 2))] = 7  # one that tells
    tracemalloc.start()
    try:
        model = fit(texts, dims, grades, 3)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    fixed = 30 * 8 * (1 << 18)  # arrays of dimensions, and a block's
    assert most - fixed <= 4 * n and model.weights[7] > 0


def brute_components(rows, percent):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), c := d if not s else least.get(find(i)), d == c) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


@pytest.mark.parametrize(("block", "hashes"), [(512, 1 << 22), (4, 1 << 22), (512, 700)])
def test_near_duplicates(spark, odd, none, block, hashes, monkeypatch):
    from corpusloom.llm import neardup
    from corpusloom.llm.neardup import near_duplicates, one_of_each

    monkeypatch.setattr(neardup, "HASHES", hashes)

    r = random.Random(11)
    rows = [tuple(x) for x in odd.select("doc_id", "text").collect()]
    for k in range(6):  # families whose members are partly linked through others only
        base = [f"f{k}_{i}" for i in range(40 + 60 * k)]
        for m in range(12):
            w = list(base)
            for _ in range(r.randrange(0, 2 + len(w) // 30)):
                w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
            rows.append((1000 + 100 * k + m, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cols = ("doc_id", "n_shingles", "component_id", "kept")
    got = [t for t in pairs(near_duplicates(docs, block=block), *cols)]
    want = brute_components(rows, 85)
    assert got == want
    assert len({t[2] for t in want}) < len(want)
    one = one_of_each(docs.withColumn("kept_id", docs.doc_id))
    assert one.columns == ["doc_id", "text", "kept_id"]
    assert near_duplicates(none).count() == 0


def test_components_of_long_chains(spark):
    from corpusloom.llm.neardup import components

    edges = [(bytes([i // 256, i % 256]), bytes([(i + 1) // 256, (i + 1) % 256])) for i in range(299)] + [(b"xx", b"yy")]
    got = components(spark.createDataFrame(edges, "a binary, b binary")).collect()
    assert len(got) == 302 and {bytes(r.root) for r in got} == {b"\0\0", b"xx"}


def test_source_mix(spark, odd, none):
    from corpusloom.llm.curriculum import mixed, rounds

    rows = [(i, "w " * (i % 50), f"s{min(i % 40, 9) if i % 7 else 0}") for i in range(900)] + [(None, "a b c", None), (5, None, "s1"), (901, "x " * 4000, "s4"), (902, "y " * 3, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixed(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in got)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    left, weight, full = total, {s: i % 3 + 1 for i, s in enumerate(names)}, set()
    while True:  # as the words say: shares, excess shared again
        unit = left / sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and unit * weight[s] > 3 * sum(r.size for r in by[s])}
        if not over:
            break
        full |= over
        left = total - sum(3 * sum(r.size for r in by[s]) for s in full)
    for s in names:
        size = sum(r.size for r in by[s])
        want = 3 * size if s in full else unit * weight[s]
        assert all(math.isclose(r.target, want, rel_tol=1e-12) and r.source_size == size for r in by[s])
        assert sum(r.taken for r in by[s]) == math.floor(want + 1e-9)
        assert all(r.taken <= 3 * r.size for r in by[s])
    assert sum(r.target for rs in by.values() for r in rs[:1]) == pytest.approx(total)
    mix = mixed(docs)
    order = rounds(mix).collect()
    assert sum(r["words"] for r in order) == sum(r.taken for r in got) == sum(math.floor(by[s][0].target + 1e-9) for s in names)
    assert [r.position for r in order] == sorted(r.position for r in order)
    whole, done, largest = sum(r["words"] for r in order), 0, max(r.size for r in got)
    used = {s: 0 for s in names}
    slope = {1: -0.5, 2: 0.0, 3: 0.5}
    for r in order:  # a position is the number of words that training reads before, but for what of each source is begun then
        assert abs(r.position - done) <= largest * len(names)
        done += r["words"]
        used[r.source] += r["words"]
        low, high = 0.0, 1.0  # the time at which all schedules' integrals have used this position
        for _ in range(50):
            t = (low + high) / 2
            sum_ = sum(math.floor(by[s][0].target + 1e-9) * ((1 - slope[weight[s]]) * t + slope[weight[s]] * t * t) for s in names)
            low, high = (t, high) if sum_ < r.position else (low, t)
        a = slope[weight[r.source]]
        assert abs(used[r.source] - by[r.source][0].target * ((1 - a) * t + a * t * t)) <= largest + 2
    assert done == whole
    late = {1: 0, 3: 0}  # a rising source has less than half of its words in the first half, a falling one more
    for r in order:
        if weight[r.source] in late and r.position < whole / 2:
            late[weight[r.source]] += r["words"]
    assert late[1] / sum(r["words"] for r in order if weight[r.source] == 1) > 0.55 and late[3] / sum(r["words"] for r in order if weight[r.source] == 3) < 0.45
    for x in got:
        n = -(-x.taken // x.size) if x.size else 0
        assert len(x.positions) == n and x.positions == sorted(x.positions)
    assert pairs(mixed(odd), "doc_id", "taken", "positions") == pairs(mixed(odd.repartition(3)), "doc_id", "taken", "positions")
    clash = odd.select("*", *(odd.extra.alias(c) for c in ("size", "key", "bucket", "digest", "target", "positions")))
    assert pairs(mixed(clash), "doc_id", "taken", "positions") == pairs(mixed(odd), "doc_id", "taken", "positions")
    assert mixed(none).count() == 0


def test_fingerprints(spark, odd, none):
    import numpy as np

    from corpusloom.llm import fingerprint as fp

    rows = sorted(((r[0], r[1]) for r in odd.select("doc_id", "text").collect()), key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))
    got = {}
    for r in fp.fingerprints(odd, chunk_bytes=30_000).collect():
        got.setdefault((r.doc_id, r.n_chars), []).append(r)
    by_text = {}
    for (i, t), (_, after) in zip(rows, [*rows[1:], rows[0]]):
        t, after = t or "", after or ""
        half = len(t) // 2
        want = hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
        mine = [r for r in got[i, len(t)] if r.edited_sha256 == want]
        assert mine
        assert by_text.setdefault(t, mine[0].fingerprint) == mine[0].fingerprint and 0 <= mine[0].near_edited <= 1 and 0 <= mine[0].near_next <= 1
    assert sum(map(len, got.values())) == len(rows)
    many = [b"First one. Second!\nThird line\n", b"Third line\nSecond! First one.", b"First one. Second!", b"Third line", b"", b"Other. Words. Here. And more."]
    v = fp.vectors(*fp._flat(many))
    one = lambda k: (v[0][k : k + 1], v[1][k : k + 1])
    same = lambda a, b: (a[0] == b[0]).all() and (a[1] == b[1]).all()
    assert same(one(0), one(1)) and same(fp.added(one(2), one(3)), one(0)) and same(fp.taken_out(one(0), one(3)), one(2)) and not v[0][4].any()
    assert fp.likeness(one(0), one(1))[0] == 1 and fp.likeness(one(0), one(2))[0] > 0.5 > fp.likeness(one(0), one(5))[0]
    assert same(fp.read(fp.written(*v)), v)
    # against the definition, and likeness against the multisets themselves
    r, pool = random.Random(9), [f"Line number {i}." for i in range(4000)]
    lists = [[r.choice(pool[:: 1 + k % 3]) for _ in range(r.randrange(1, 300))] for k in range(60)] + [[pool[0]] * 40_000, [pool[0]] * 40_000 + pool[:3000] * 10]
    many = ["\n".join(x).encode() for x in lists]
    v = fp.vectors(*fp._flat(many))
    for k in (0, 7, 60):
        sums = [0] * fp.WIDE
        for line in lists[k]:
            digest = hashlib.blake2b(line.encode(), person=b"lanes").digest()
            sums = [(s + int.from_bytes(digest[8 * i : 8 * i + 8], "little")) % (1 << 64) for i, s in enumerate(sums)]
        assert v[0][k].tolist() == sums
    assert same(fp.read(fp.written(*v)), v) and {f[0] for f in fp.written(*v)} == {"1", "4"}
    off = []
    for i in range(len(many)):
        for j in range(i):
            x, y = collections.Counter(lists[i]), collections.Counter(lists[j])
            apart, both = sum((x[w] - y[w]) ** 2 for w in x | y), sum(c * c for c in (*x.values(), *y.values()))
            off.append(fp.likeness(one(i), one(j))[0] - max(0.0, 1 - apart / both))
    assert max(map(abs, off)) < 0.25 and (sum(x * x for x in off) / len(off)) ** 0.5 < 0.045
    assert fp.likeness(one(60), one(61))[0] > 0.8
    assert fp.fingerprints(none).count() == 0


def test_context_counts_stay_exact_on_large_vocabularies(spark):
    """More pairs than the 2^16 to 2^22 slots that tables once had: each word's count of its own is told from all others'."""
    import numpy as np

    from corpusloom.llm import contextmix as cm

    r = np.random.default_rng(5)
    letters = r.integers(0x61, 0x7B, (300_000, 8)).astype(np.uint8)
    at = np.arange(len(letters) + 1) * 8
    tables = cm.empty_tables()
    cm.count_bits(tables, cm.Spelled(letters.reshape(-1), at), np.ones(len(letters), np.int64))
    known, unknown = letters[:5000], r.integers(0x41, 0x5B, (5000, 8)).astype(np.uint8)
    whole = lambda w: tables.paths(cm.Spelled(w.reshape(-1), np.arange(len(w) + 1) * 8))[8, -1].reshape(-1, 9)
    alike = {}
    for w in map(bytes, letters):
        alike[w] = alike.get(w, 0) + 1
    assert whole(known)[:, -1].tolist() == [alike[bytes(w)] for w in known]
    assert not whole(unknown).any()
    docs = spark.createDataFrame([(i, " ".join(f"w{i * 7 + k} q{k % 5}" for k in range(40))) for i in range(60)], "doc_id long, text string")
    lexicon = cm.counted(cm.packs(docs, "doc_id", "text", 2000, 7), 7)
    rows, ends = cm.informed(lexicon, 5, 3)
    merged = [(cm._merged(bytes(x.blob))[:3], x.answers) for x in rows.collect()]
    spelled = lambda at, text: cm.Spelled(np.asarray(text), at)
    tables = cm.empty_tables()
    cm.count_bits(tables, cm._end(), np.array([3]))
    for (at, counts, text), _ in merged:
        cm.count_bits(tables, spelled(at, text), counts)
    assert len(merged) > 1 and (ends.paths(cm._end()) == tables.paths(cm._end())).all()
    for (at, counts, text), say in merged:  # shards say what one table of everything does
        x = spelled(at, text)
        assert (cm._answers(at, counts, text, say).paths(x) == tables.paths(x)).all()


def test_sorted_hashes_equal_plain_ones():
    """Hashes that agree in their first bits are told apart, too."""
    import numpy as np

    from corpusloom.llm import bytetext as bt
    from corpusloom.llm import contextmix as cm

    r = np.random.default_rng(3)
    near = (r.integers(0, 4, 3000).astype(np.uint64) << np.uint64(60)) + r.integers(0, 5, 3000).astype(np.uint64) * np.uint64(256) + r.integers(0, 3, 3000).astype(np.uint64)
    ends = np.array([2**64 - 1, 0, 2**64 - 1, 2**64 - 257, 1], np.uint64)
    for keys in (near, np.concatenate([r.integers(0, 2**64, 5000, dtype=np.uint64), near]), ends, ends[:1], ends[:0], np.full(9, 7, np.uint64)):
        for low in (0, 8):
            order, there = bt.ranked(keys, low)
            assert (order == np.argsort(keys, kind="stable")).all() and (there == np.sort(keys)).all()
            assert all((x == y).all() for x, y in zip(bt.distinct(keys, low), np.unique(keys, return_index=True, return_inverse=True)))
    for key in (r.integers(0, 50, 999), r.integers(0, 1 << 62, 999), np.zeros(0, np.int64)):
        order, new = cm._grouped(key)
        assert (order == np.argsort(key, kind="stable")).all() and new.sum() == len(set(key.tolist()))


def test_context_mixing_sorts_no_places_and_takes_few_steps(monkeypatch):
    """What took most of its time: the places of all pairs and tokens were sorted, and each bit of a token was a step of its own."""
    import numpy as np

    from corpusloom.llm import contextmix as cm

    r, work = np.random.default_rng(6), collections.Counter()

    def counting(name, f, size):
        def run(x, *args, **more):
            work[name] += size(x)
            return f(x, *args, **more)

        monkeypatch.setattr(np, name, run)

    counting("unique", np.unique, np.size)
    counting("argsort", np.argsort, np.size)
    counting("exp", np.exp, lambda x: 1)
    text, at = r.integers(0x61, 0x6A, 80_000).astype(np.uint8), np.arange(0, 80_001, 8)
    assert len(cm.Bucket(at, text).pairs) > 10_000 and work["unique"] + work["argsort"] < 1000
    course = cm.Course(r.integers(0, 60, 3000), np.arange(0, 3001, 500), np.full(60, 5))
    assert work["unique"] + work["argsort"] < 1000
    flow = cm.Flow(course.counts(np.zeros(6, bool)), 0.1)
    work.clear()
    flow.logs(course, r.random(len(course.word)) < 0.8)
    assert 0 < work["exp"] <= 502 < course.coded.sum(axis=1).max()


def test_blocks_of_bytes_learn_what_the_whole_batch_does(monkeypatch):
    import numpy as np

    from corpusloom.llm import contextmix as cm

    r = np.random.default_rng(2)
    text, at = r.integers(0x61, 0x64, 900).astype(np.uint8), np.arange(0, 901, 3)
    counts, spelled, tables = r.integers(1, 90, 300), cm.Spelled(text, at), cm.empty_tables()
    cm.count_bits(tables, spelled, counts)

    def learned():
        mixer, forks = cm.Mixer(), cm.chooser()
        pairs, found, of = tables.looked_up(spelled)
        bits = cm.Forks(spelled, of, cm.Forks.parting(found), *cm.odds(pairs, found, True), np.arange(len(spelled.flat)))
        for _ in range(5):
            mixer.learn((pairs, found, of), spelled, counts)
            forks.step(bits.x, bits.level, bits.place, bits.bit, counts[bits.word].astype(float))
        return mixer.weights, mixer.refine, forks.weights, forks.refine

    whole = learned()
    monkeypatch.setattr(cm, "BLOCK", 7)
    assert all(np.allclose(x, y, rtol=1e-9, atol=1e-12) for x, y in zip(whole, learned())) and not np.allclose(whole[0], cm.Mixer().weights)


def test_bits_go_on_by_steps():
    """Each cell's bits in their order, a bit of each in a step, and those of a step in the first cells by rank."""
    import numpy as np

    from corpusloom.llm import contextmix as cm

    cell = np.sort(np.random.default_rng(4).integers(0, 30, 400))
    cell = cell[cell != 7]  # a cell without bits
    order, cuts, rank = cm._steps(cell, 31)
    assert sorted(order.tolist()) == list(range(len(cell))) and cuts[-1] == len(cell)
    seen = {}
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        assert rank[cell[order[a:b]]].tolist() == list(range(b - a))
        for i in order[a:b].tolist():
            seen.setdefault(int(cell[i]), []).append(i)
    assert all(x == sorted(x) and len(x) == (cell == c).sum() for c, x in seen.items()) and len(cuts) - 1 == np.bincount(cell).max()
    order, cuts, _ = cm._steps(cell[:0], 3)
    assert len(order) == 0 and cuts.tolist() == [0]


def test_secret_layers_of_any_bytes():
    from corpusloom.llm import secrets as sc

    key = "AKIA" + "A1B2C3D4E5F6G7H8"
    inner = f"token={key} more"
    wrap = lambda raw: base64.b64encode(raw).decode()
    for raw in (inner.encode("utf-16-le"), inner.encode("utf-16-be"), inner.encode("utf-16"), b"x" + inner.encode("utf-16-le"), inner.encode("utf-32"), ("é " + inner).encode("latin-1"), bytes(range(128, 256)) * 9 + inner.encode() + b"\xff\0\1"):
        for data in (raw, gzip.compress(raw), gzip.compress(b"first ") + gzip.compress(raw), gzip.compress(b"first") + b"\0" * 9 + gzip.compress(raw), gzip.compress(zlib.compress(raw)), zlib.compress(b"first") + b" " + raw):
            text = f"a {wrap(data)}. b"
            _, more, *_ = sc.scan(text)
            assert {k for a, b, k in more if text[a:b].rstrip("=") == wrap(data).rstrip("=")} >= {"assign", "access"}, (raw, data)
            assert sc.scan(sc.redacted(text, more))[1] == []
    noise = random.Random(3).randbytes(300)
    for end in ("\n", "\r\n", "\n  "):
        for width in (20, 64, 76):
            for data in (gzip.compress(noise + inner.encode()), noise + inner.encode()):
                code = wrap(data)
                lines = end.join(code[i : i + width] for i in range(0, len(code), width))
                for after in ("", "\nthen words"):
                    text = f"see:\n{lines}{after}"
                    _, more, *_ = sc.scan(text)
                    assert {k for _, _, k in more} >= {"assign", "access"}
                    assert sc.scan(sc.redacted(text, more))[1] == []


def test_secrets_of_layers_too_large_to_hold(monkeypatch):
    from corpusloom.llm import secrets as sc

    monkeypatch.setattr(sc, "MAX_LAYER", 1 << 18)
    key = "AKIA" + "A1B2C3D4E5F6G7H8"
    nested = base64.b64encode(gzip.compress(random.Random(4).randbytes(90_000) + f" secret={key}".encode()))
    filler = b"some words, and more. " * 30_000
    for at in (0, 200_000, (1 << 18) - 10, 1 << 18, 300_000, 660_000):
        for hidden in (f" {key} ".encode(), nested):
            raw = gzip.compress(filler[:at] + b", " + hidden + b", " + filler[at:])
            text = f"see {base64.b64encode(raw).decode()}"
            base, more, _, unopened = sc.scan(text)
            assert not base and "access" in {k for _, _, k in more} and unopened == 1, (at, hidden[:9])
            assert sc.scan(sc.redacted(text, more))[1] == []


def test_pipeline_places_every_reading(spark):
    import corpus_pipeline as cp
    from corpusloom.llm.curriculum import mixed, rounds

    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), "small" if i < 30 else "large") for i in range(900)] + [(999, "", "small")], "doc_id long, text string, source string")
    out = {r.doc_id: r for r in cp.mixture(spark, docs, "").collect()}
    want = {}
    for r in rounds(mixed(docs)).collect():
        want.setdefault(r.doc_id, {})[r["round"]] = r.position
    assert max(map(len, want.values())) == 3 and len(out) == 901
    assert all(r.positions == [want.get(i, {})[k] for k in sorted(want.get(i, {}))] for i, r in out.items())
    first = [r.positions[0] for r in cp.mixture(spark, docs, "").collect() if r.positions]
    assert first == sorted(first)


def test_near_duplicate_misses_at_every_threshold():
    from corpusloom.llm.neardup import common_of, linked

    import numpy as np

    for percent in (50, 70, 80, 85, 95):
        t, p = common_of(percent), percent / 100
        tail = lambda n: sum(math.comb(64, k) * p**k * (1 - p) ** (64 - k) for k in range(n))  # noqa: B023, E731
        assert tail(t) <= 1e-8 < tail(t + 1)
    assert common_of(85) == 36 > common_of(80)
    # a set inside another at 80 %, with few of the sketch in common: 33 of 64, which lists and estimates by 36 or 0.55 lose
    small = np.concatenate([np.arange(33), 10**6 + np.arange(767)]).astype(np.uint64)
    other = np.concatenate([small, 100 + np.arange(31), 2 * 10**6 + np.arange(169)]).astype(np.uint64)
    pair = [np.sort(small), np.sort(other)]
    assert linked(pair, 80) == [(0, 1)] and common_of(80) <= 33


RESULTS = {
    "op1": "content n_bytes n_tokens over_limit hot_tokens tokenizer",
    "op2": "held_out n_known train_tokens base_score score bits_per_byte chunk bucket",
    "op3": "n_words n_hit n_items items_sha256 contaminated longest_match items found own_0",
    "op4": "n_bytes n_removed n_spans kept_sha256 kept chunk blob",
    "op6": "n_assign n_access n_hex base_sha256 spans n_layers n_unopened",
    "op7": "expected_grade tail_probability kept g own_0 grade",
    "op8": "n_shingles component_id kept node sketch n asked_id kept_id",
    "op9": "size source_size target taken positions digest key",
    "op10": "edited_sha256 fingerprint edited_fingerprint near_edited near_next chunk",
}


@pytest.mark.parametrize("op", sorted(RESULTS))
def test_large_ids_and_clashing_names(spark, op, tmp_path):
    """Ids near both ends of 64 bits, and extra columns named like results and intermediates, change nothing but the ids."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from corpusloom.llm import contextmix, curriculum, decontam, fingerprint, neardup, ordinal, secrets, suffixdedup, tokencount

    texts = ["one two three four five six seven eight nine ten eleven " * 3, "a" * 300, "token=abcdef12 and more words of a text", "one two three four five six seven eight nine ten eleven " * 3, "", None]
    small = [(k, t, f"s{k % 2}", "en", 1) for k, t in enumerate(texts)]
    shift = lambda k: (-(1 << 63), -5, 1 << 53, (1 << 53) + 1, (1 << 63) - 2, (1 << 63) - 1)[k]
    schema = "doc_id long, text string, source string, lang string, n_chars long"
    plain = spark.createDataFrame(small, schema)
    large = spark.createDataFrame([(shift(r[0]), *r[1:]) for r in small], schema).select("*", *(F.lit("x").alias(c) for c in RESULTS[op].split()))
    bench = spark.createDataFrame([(1, texts[0])], "item_id long, text string")
    labels = lambda f: spark.createDataFrame([(f(k), k % 2, 0) for k in range(5)], "doc_id long, quality int, toxic int")

    def run(docs, f):
        return {
            "op1": lambda: tokencount.count_tokens(docs, str(public_tokenizers.path("word_bpe_49k.json")), f"file://{tmp_path}/{f(0)}").select("doc_id", "n_tokens"),
            "op2": lambda: contextmix.scored(docs).select("doc_id", "n_tokens"),
            "op3": lambda: decontam.matched(docs, bench, ["doc_id"]).select("doc_id", "n_hit", "longest_match"),
            "op4": lambda: suffixdedup.without_repeats(docs, chunk_bytes=200).select("doc_id", "n_removed", "kept_sha256"),
            "op6": lambda: secrets.secret_spans(docs).select("doc_id", "spans"),
            "op7": lambda: ordinal.graded(docs, ordinal.fitted(docs, labels(f)), ["doc_id"]).select("doc_id", F.round("tail_probability", 6)),
            "op8": lambda: neardup.near_duplicates(docs).select("doc_id", "n_shingles", "kept"),
            "op9": lambda: curriculum.mixed(docs).select("doc_id", "size", "source_size"),
            "op10": lambda: fingerprint.fingerprints(docs, chunk_bytes=200).select("doc_id", "edited_sha256", "near_next"),
        }[op]()

    want = sorted((shift(r[0]), *r[1:]) for r in run(plain, lambda k: k).collect())
    assert sorted(tuple(r) for r in run(large, shift).collect()) == want and len(want) == 6
