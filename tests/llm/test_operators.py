"""The ten operators on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from strataq.llm import bpe, components, decontaminate, langid, lm, media, pii, quality, sharding, simhash, simhash_wide, urlfilter
from strataq.llm.common import remainder, staged

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, _text string, score double"
LONG = "the quick brown fox " * 8000


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, an empty, a blank and a very long text, copies, a whole repeated row, columns with used names."""
    texts = [(1, "Hello brave new world of words and more words"), (2, None), (3, ""), (4, " \t\n "), (5, LONG), (6, "Hello brave new world of words and more words"), (6, "Hello brave new world of words and more words"), (None, "mail a.b@example.com or +1 202 555 0147 now"), (7, "日本語 é x 😀"), (8, "\x00\x1f")]
    return spark.createDataFrame([(i, t, "en" if t else None, "mine", 0.5) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_bpe_is_tiktoken_and_round_trips(spark, odd, none):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    extra = spark.createDataFrame([(9, "a" * 3000 + "b" * 500 + " " * 700, None, "m", 0.0), (10, "it's we'll 12345 ünïcödé\r\n\r\n  x", None, "m", 0.0)], SCHEMA)
    for r in bpe.encode(odd.unionByName(extra), path, public_tokenizers.PATTERN, [F.col("doc_id"), F.col("text"), F.col("_text").alias("n")]).collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == library.encode_ordinary(r.text or "") and r.n_tokens == len(ids)
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(none, path, public_tokenizers.PATTERN, [F.col("doc_id")]).count() == 0


def _grams_by_hand(docs, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    for t in docs:
        w, hit, found = words(t), set(), set()
        for i, text in items:
            x = words(text)
            k = min(n, len(x))
            for s in range(len(x) - k + 1 if x else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == x[s : s + k]:
                        hit |= set(range(p, p + k))
                        found.add(str(i))
        yield len(w), len(hit), sorted(found)


def test_decontamination(spark, none, monkeypatch):
    passage = "One two three four five six seven eight nine ten eleven twelve"
    texts = [f"start {passage.upper()} end", "only one two", None, "", "x, one-two three! 4 five", passage + " " + passage, "short item here and SHORT, item"]
    items = [(1, passage), (2, "short item"), (3, None), (4, ""), (None, "only one two"), (10, "eleven twelve one two three four five six seven eight nine")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = list(_grams_by_hand(texts, [(i, t) for i, t in items]))
    for size in (1 << 20, 64):  # the smaller one deals the benchmark over several sets
        monkeypatch.setattr(decontaminate, "SET_BYTES", size)
        rows = decontaminate.scan(docs, bench, [F.col("doc_id")]).orderBy("doc_id").collect()
        assert [(r.n_words, r.n_hit, [x for x in r.items]) for r in rows] == [(n, h, [x for x in i if x != "None"]) for n, h, i in want]
        cleaned = {r.doc_id: r.cleaned for r in decontaminate.scan(docs, bench, [F.col("doc_id")], remove="spans").collect()}
        assert cleaned[0] == "start  end" and cleaned[2] is None and cleaned[6] == " here and "
        assert {r.doc_id for r in decontaminate.scan(docs, bench, [F.col("doc_id")], remove="documents").collect()} == {2, 3, 4}
    clash = decontaminate.scan(docs, bench, [F.col("doc_id"), F.lit(9).alias("n_hit"), F.lit(8).alias("_text"), F.lit(7).alias("_row")], remove="spans")
    assert clash.columns == ["doc_id", "_text", "_row", "cleaned", "n_words", "n_hit", "n_items", "items"] and clash.where("n_hit = 9").count() == 0
    long = spark.createDataFrame([(1, "word " * 60_000 + passage)] * 2, "doc_id int, text string")  # a long text, and the same row again
    assert [(r.n_words, r.n_hit) for r in decontaminate.scan(long, bench, [F.col("doc_id")]).collect()] == [(60_012, 12)] * 2
    assert decontaminate.scan(none, bench, [F.col("doc_id")]).count() == 0
    assert decontaminate.scan(docs, bench.limit(0), [F.col("doc_id")]).where("n_hit > 0").count() == 0


def test_url_rules(spark):
    urls = ["http://a.example.com/en/1?x", "https://WWW.Example.com/en/#t", "http://com/x", "http://net/fr/", "http://a.b.net/es/z", "http://xcom/", "no scheme", None, "http://example.com", "http://example.com?/en/", "://net/es/1", "http://deep.www.example.com/en/q", "http://example.com/en"]
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("net", "/es/", "allow"), (None, "/", "block"), ("example.com", "/e", "block"), ("net", None, "block")]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(0, urls[0], "h")], "page_id int, url string, host string")
    df = spark.createDataFrame(rules, "host string, path string, verdict string")

    def by_hand(u):
        rest = u.partition("://")[2] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [(len(h) + len(p), len(h), h + p, v == "block") for h, p, v in rules if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[2], "block" if best and best[3] else "allow"

    for salts in (1, 3):
        found = urlfilter.judge(pages, df, [F.col("page_id")], salts=salts).collect()
        assert len(found) == len(urls) + 1
        assert all((r.host, r.path, r.rule, r.verdict) == by_hand(urls[r.page_id]) for r in found)
    assert {r.verdict for r in urlfilter.judge(pages, df.limit(0), [F.col("page_id")], default="block").collect()} == {"block"}
    plan = urlfilter.judge(pages, df, [F.col("page_id")])._jdf.queryExecution().toString()
    assert not re.search("Cartesian|NestedLoop|Python|Arrow", plan)


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontaminate, "_hashes", lambda ids, place, n: np.zeros(len(place), np.uint64) + (ids[place] & 1))
    texts = ["a b c d e f g h i j k l", "b c d e f g h i j k z", "x y", "no hit at all here"]
    items = [("1", "a b c d e f g h i j"), ("2", "c d e f g h i j k l m"), ("3", "x y"), ("4", "b c d e f g h i j k"), ("1", "a b c d e f g h i j")]
    grams = decontaminate.Grams(items)
    for t, (n, hit, found) in zip(texts, _grams_by_hand(texts, items), strict=True):
        spans, names = grams.scan(decontaminate.words_of(t))
        assert (sum(b - a for a, b in spans), sorted(names)) == (hit, found)


def _components(ids, prints, most):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(ids)), 2):
        if bin(prints[a] ^ prints[b]).count("1") <= most:
            parent[find(a)] = find(b)
    least = defaultdict(lambda: 1 << 60)
    for i, x in enumerate(ids):
        least[find(i)] = min(least[find(i)], x if x is not None else 1 << 60)
    return [least[find(i)] for i in range(len(ids))]


def test_simhash_matches_brute_force(spark, docs, odd, none, monkeypatch):
    import xxhash

    def by_hand(t, k=4):
        w = (t or "").encode().lower().split()
        grams = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    for df in (docs.limit(150), odd):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        prints = [by_hand(t) for _, t in rows]
        want = Counter(zip([x for x, _ in rows], prints, _components([x for x, _ in rows], prints, 4), strict=True))
        for piece in (8192, 3):  # the smaller one deals shards over several tasks
            monkeypatch.setattr(simhash, "SLICE", piece)
            found = simhash.near_duplicates(df, [F.col("doc_id")], F.col("doc_id")).collect()
            assert Counter((r.doc_id, r.fp % 2**64, r.component_id if r.component_id is not None else 1 << 60) for r in found) == want
    assert simhash.near_duplicates(none, [F.col("doc_id")], F.col("doc_id")).count() == 0


def test_trees_and_shards_miss_no_pair(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    x = np.unique(np.concatenate([base, base[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)), base[:100] ^ np.uint64(0b1111 << 20)]))
    pairs = [(int(a), int(b)) for a, b in itertools.combinations(x, 2) if int(a ^ b).bit_count() <= 4]
    assert pairs
    for links in (list(simhash.tree_links(x, x, 4)),):
        label = {int(v): int(v) for v in x}

        def find(v):
            while label[v] != v:
                v = label[v]
            return v

        for a, b in links:
            for u, v in zip(a.tolist(), b.tolist(), strict=True):
                label[find(u)] = find(v)
        assert all(find(a) == find(b) for a, b in pairs)
    df = spark.createDataFrame([(int(np.int64(v.view(np.int64))),) for v in x], "fp long")
    found = {r.node: r.root for r in components.roots(simhash.near_links(df, 4)).collect()}
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    assert all(found[signed(a)] == found[signed(b)] for a, b in pairs)
    for n in (10, 10**6, 10**9):  # wider runs for more fingerprints keep the guarantee
        a, b = 0x123456789ABCDEF0, 0x123456789ABCDEF0 ^ (1 << 3 | 1 << 17 | 1 << 40 | 1 << 63)
        assert any(a & mask == b & mask for mask in (sum(1 << k for k in c) for c in simhash._choices(4, n)))


def test_a_hot_shard_is_split_and_misses_no_pair(spark, monkeypatch):
    """Fingerprints that share most bits: shards over the limit at every level."""
    monkeypatch.setattr(simhash, "SLICE", 1500)
    rng = np.random.default_rng(3)
    x = np.unique(rng.integers(0, 2**22, 9000, dtype=np.uint64) | np.uint64(0x5A5A5A << 40))
    far = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
    some = np.concatenate([x[:: len(x) // 40], far])
    near = {int(a): {int(b) for b in np.concatenate([x, far])[np.bitwise_count(np.concatenate([x, far]) ^ a) <= 4]} for a in some}
    df = spark.createDataFrame([(int(v.view(np.int64)),) for v in np.concatenate([x, far])], "fp long")
    found = {r.node: r.root for r in components.roots(simhash.near_links(df, 4)).collect()}
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    for a, others in near.items():
        assert len({found.get(signed(b), signed(b)) for b in others | {a}}) == 1


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(10_200, 12_260)] + [(5, 5), (None, 3)]
    found = {r.node: r.root for r in components.roots(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(found[i] == 100 for i in range(100, 141)) and all(found[i] == 7 for i in range(10_200, 12_260)) and 5 not in found
    assert components.roots(spark.createDataFrame([], "u long, v long")).count() == 0


def test_wide_near_duplicates(spark, none):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    texts = []
    for _ in range(30):
        w = [word() for _ in range(200)]
        texts += [" ".join(w), " ".join([*w[:100], "other", *w[101:]]), " ".join([*w[:150], word(), *w[150:]])]
    rows = [(i, t, None, "m", 0.0) for i, t in enumerate(texts)] + [(500, None, None, "m", 0.0), (501, "", None, "m", 0.0), (None, texts[0], None, "m", 0.0), (3, texts[3], None, "m", 0.0), (600, "two words", None, "m", 0.0)]
    kept = simhash_wide.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "lang", "_text", "score"]
    assert sorted(r.doc_id for r in kept.collect()) == [*range(0, 90, 3), 500, 600]
    assert simhash_wide.drop_near_duplicates(none).count() == 0


def test_packing_is_best_fit_decreasing():
    def plain(sizes, capacity):
        left = []
        for s in sorted(sizes, reverse=True):
            fits = [(r, i) for i, r in enumerate(left) if r >= s]
            if fits:
                left[min(fits)[1]] -= s
            else:
                left.append(max(capacity, s) - s)
        return sorted(left)

    rng = np.random.default_rng(4)
    for _ in range(30):
        sizes = rng.integers(1, 40, rng.integers(1, 80)).tolist()
        plan = sharding.best_fit_decreasing(list(Counter(sizes).items()), 50)
        assert sorted(50 - x for x in plan.loads) == plain(sizes, 50)
        for c, n in Counter(sizes).items():
            spans = sorted((a, b) for k, a, b, _ in plan.pieces if k == c)
            assert spans[0][0] == 0 and spans[-1][1] == n and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_sharding(spark, docs, odd):
    for df, most in ((docs.select("doc_id", "text"), 6), (odd.select("doc_id", "text"), 3)):
        text = F.coalesce("text", F.lit(""))
        rows = df.select("doc_id", "text", (F.octet_length(text) + 16).cast("long").alias("size"), F.sha2(text, 256).alias("g"))
        found = sharding.pack(rows, "g", "size", [F.col("doc_id"), F.col("g")], shards=most).collect()
        assert len(found) == df.count()
        slots = defaultdict(list)
        for r in found:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(slots) < most
        assert len({(r.g, r.shard) for r in found}) == len({r.g for r in found})
    loads = Counter()
    for r in sharding.pack(docs.select(F.octet_length("text").cast("long").alias("size"), F.md5("text").alias("g")), "g", "size", [F.col("g")], shards=4).collect():
        loads[r.shard] += r.size
    assert max(loads.values()) < 1.02 * min(loads.values())
    sizes = spark.createDataFrame([("a", 60), ("b", 50), ("c", 50), ("d", 40), ("e", 200)], "g string, size long")
    assert len({r.shard for r in sharding.pack(sizes, "g", "size", [F.col("g")], capacity=100).collect()}) == 3
    assert sharding.best_fit_decreasing([], 10).loads == [] and sharding.best_fit_decreasing([(3, 0)], 10).loads == []
    assert sharding.pack(sizes.limit(0), "g", "size", [F.col("g")], shards=2).count() == 0
    with pytest.raises(ValueError):
        sharding.pack(sizes, "g", "size", [F.col("g")])


def test_tree_of_bins():
    rng, tree, plain = np.random.default_rng(18), sharding.Tree(), []
    for i in range(3000):
        if rng.random() < 0.6:
            key = (int(rng.integers(0, 50)), i)
            tree.add(key), plain.append(key)
        else:
            size = (int(rng.integers(0, 55)), -1)
            want = min((k for k in plain if k >= size), default=None)
            assert tree.pop_from(size) == want
            plain = [k for k in plain if k != want]


def test_shards_that_nothing_refers_to_go(spark, odd):
    rows = media.store(odd, [F.col("doc_id")])
    folder = rows.first().shard.rpartition("/")[0].removeprefix("file://")
    with open(f"{folder}/lost.tar", "wb") as f:
        f.write(b"x")
    assert media.sweep(rows) == 1 and media.sweep(rows) == 0 and media.features(rows).count() == odd.count()


def test_media_round_trip(spark, odd, none):
    rows = media.store(odd, [F.col("doc_id"), F.col("text"), F.col("_text").alias("shard_of")])
    for r in media.features(rows).collect():
        raw = (r.text or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.width, r.height, r.bit_depth) == (64, len(payload) // 64, 8)
    found = media.metadata(rows).collect()
    assert all(r.width == 64 for r in found) and len({(r.digest, r.length) for r in found}) == len({r.digest for r in found})
    shard = found[0].shard.removeprefix("file://")
    with open(shard, "rb") as f:
        names = media.members(f.read())
    assert len(names) == len(set(names)) and {n.removesuffix(".png") for n in names} == {r.digest for r in found if r.shard.endswith(shard)}
    assert media.features(media.store(none, [F.col("doc_id")])).count() == 0
    with pytest.raises(ValueError):
        media.header(b"GIF89a" * 8)


def _base_by_hand(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_match_plain_patterns(docs):
    rng = np.random.default_rng(6)
    parts = ["a@b.c", "x.y+z@", "@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "+1 (202) 555-0147", "+", "12-34", " ", ".", "é", "007.08.9.10", "a@b-.c..d", "%%", "99999999999999999999"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 12))) for _ in range(800)] + [r.text for r in docs.limit(60).collect()] + ["x" * 5000 + "@a.bc", "1" * 3000 + ".2.3.4"]
    for t in texts:
        assert pii.base_spans(t) == _base_by_hand(t), t


def test_windows_left_out_hold_nothing():
    """Only windows without a character that may be tagged are left out; computing them all gives the same spans."""
    rng = np.random.default_rng(7)
    tagger = pii.Tagger.fresh(3)  # untrained: it tags whatever it may
    texts = []
    for _ in range(60):
        t = "".join(rng.choice(list("ab 1@"), rng.integers(0, 500), p=[0.4, 0.3, 0.286, 0.007, 0.007]))
        may = pii.near_trigger(t)
        near = [any(abs(i - m.start()) <= pii.NEAR + 1 for m in re.finditer("[0-9@]", t)) for i in range(len(t))]
        assert all(n or not m for m, n in zip(may, near, strict=True))
        grid = range(0, max(1, len(t) - pii.WINDOW + pii.STRIDE), pii.STRIDE)
        assert pii.window_starts(may).tolist() == [s for s in grid if may[s : s + pii.WINDOW].any()]
        texts.append(t + " call (202) 555 0147")
    assert pii.tag_texts(texts, tagger) == pii.tag_texts(texts, tagger, everywhere=True)


def test_decoding_is_the_best_of_all_paths():
    rng = np.random.default_rng(17)
    tagger = pii.Tagger.fresh(4)
    tagger.p["t"] = rng.normal(0, 1, (pii.TAGS, pii.TAGS)).astype(np.float32)
    ids, may = rng.integers(0, pii.PAD, (5, 4)).astype(np.uint8), rng.random((5, 4)) < 0.7
    scores = tagger.limited(ids, may).astype(np.float64)
    move = tagger.p["t"] + pii._FORBIDDEN
    found = tagger.decode(ids, may)
    chance = tagger.marginals(ids, may, found)
    for r in range(len(ids)):
        paths = {p: pii._FIRST[p[0]] + sum(scores[t, r, p[t]] for t in range(4)) + sum(move[a, b] for a, b in itertools.pairwise(p)) for p in itertools.product(range(pii.TAGS), repeat=4)}
        assert tuple(found[r].tolist()) == max(paths, key=paths.get)
        top = max(paths.values())
        weight = {p: math.exp(v - top) for p, v in paths.items()}
        for t in range(4):
            share = sum(w for p, w in weight.items() if p[t] == found[r, t]) / sum(weight.values())
            assert abs(share - chance[r, t]) < 1e-4


def test_gradients_match_differences():
    rng = np.random.default_rng(8)
    tagger = pii.Tagger.fresh(3)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    ids, tags = rng.integers(0, pii.PAD, (3, 7)).astype(np.uint8), np.array([[0, 1, 2, 0, 3, 4, 4], [0] * 7, [7, 8, 8, 0, 5, 6, 0]], np.int8)
    _, g = tagger.gradients(ids, tags)
    for k in g:
        for _ in range(3):
            at = tuple(rng.integers(0, n) for n in tagger.p[k].shape)
            kept, e = tagger.p[k][at], 1e-3
            tagger.p[k][at] = kept + e
            up, _ = tagger.gradients(ids, tags)
            tagger.p[k][at] = kept - e
            down, _ = tagger.gradients(ids, tags)
            tagger.p[k][at] = kept
            assert abs((up - down) / (2 * e) - g[k][at]) < 2e-3


def test_pii_keeps_base_and_adds_variants(spark, docs, odd, none):
    tagger = pii.fit(docs)
    rows = pii.scan(odd, tagger, [F.col("doc_id"), F.col("text"), F.col("score")]).collect()
    for r in rows:
        base = _base_by_hand(r.text or "")
        assert r.base == pii.written(base) and set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
        assert (r.redacted is None) == (r.text is None)
    assert any(r.n_email == 1 and r.n_phone == 1 and r.redacted == "mail [EMAIL] or [PHONE] now" for r in rows)
    rng, hit, false = np.random.default_rng(9), 0, 0
    for _ in range(120):
        kind, before, form = pii.variants(rng)
        text = f"some words before {before}{form} and some words after it"
        start = 18 + len(before)
        hit += any(k == kind and abs(a - start) <= 1 and abs(b - start - len(form)) <= 1 for k, a, b in pii.tag_texts([text], tagger)[0])
        other = f"some words before {pii.clutter(rng)} and some words after it"
        false += len(pii.tag_texts([other], tagger)[0]) > len(pii.base_spans(other))
    assert hit >= 70 and false <= 8
    found = pii.scan(odd, tagger, [F.col("doc_id"), F.lit(1).alias("spans"), F.lit(2).alias("_kept"), F.col("text").alias("_text")])
    assert found.columns[:3] == ["doc_id", "_kept", "_text"] and found.columns.count("spans") == 1 and found.count() == odd.count()
    assert pii.scan(none, tagger, [F.col("doc_id")]).count() == 0
    assert pii.tag_texts(["nothing here"], pii.fit(none)) == [[]]


def test_language_id(spark, docs, odd, none):
    held = remainder(F.col("doc_id"), 5) == 0
    known = langid.fit(docs, ~held)
    found = langid.predict(docs.where(held), known, [F.col("lang")]).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.85 * len(found) and all(0 <= r.score <= 1 for r in found)
    rows = langid.predict(odd, known, [F.col("doc_id"), F.col("text"), F.col("score").alias("old")]).collect()
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, r.text or ""))) for r in rows)
    assert langid.fit(none, F.lit(True)) == {} and langid.predict(odd, {}, [F.col("doc_id")]).where("lang_pred <> 'und'").count() == 0
    assert {r.lang_pred for r in langid.predict(docs, known, [], margin=0.99).collect()} == {"und"}


def test_quality(spark, docs, odd, none):
    names = [F.col("doc_id"), F.lit(1).alias("score"), F.lit(2).alias("predicted"), F.lit(3).alias("_t"), F.lit(4).alias("kept")]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rules = quality.fit(docs, labels, remainder(F.col("doc_id"), 3) != 1)
    joined = quality.predict(docs, rules, [F.col("doc_id")]).join(labels, "doc_id").where(remainder(F.col("doc_id"), 3) == 1).collect()
    assert sum(r.predicted == r.quality for r in joined) >= 0.85 * len(joined)
    rows = quality.predict(odd, rules, [F.col("doc_id"), F.col("lang")]).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert quality.fit(docs, labels.limit(0), F.lit(True)).rules == []
    clash = quality.predict(odd, rules, names)
    assert clash.columns == ["doc_id", "_t", "kept", "score", "predicted"] and clash.where("_t = 3 AND kept = 4").count() == odd.count()
    assert quality.predict(none, rules, names).count() == 0
    twice = labels.unionByName(labels).unionByName(labels.select("doc_id", (1 - F.col("quality")).cast("int").alias("quality"), "toxic").limit(1))
    assert len(quality.fit(docs.unionByName(docs), twice, F.lit(True)).rules) > 0  # repeated rows of keys and labels
    plan = quality.predict(docs, rules, [F.col("doc_id")])._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Exchange|Join", plan)


def test_lasso_drops_noise():
    rng = np.random.default_rng(10)
    x = rng.normal(size=(1200, 4))
    rules = quality.train(x, ((x[:, 0] > 0.3) & (x[:, 1] < 0.5)).astype(float), ("a", "b", "c", "d"))
    weight = Counter()
    for rule, w in zip(rules.rules, rules.weights, strict=True):
        for name, _, _ in rule:
            weight[name] += abs(w)
    assert weight["a"] > 3 * weight["c"] and weight["b"] > 3 * weight["d"]


def test_base_score_matches_brute_force(spark, docs, odd, none, monkeypatch):
    monkeypatch.setattr(lm, "DICT_BITS", 3)  # most words are then found by their hashes, or in the join
    monkeypatch.setattr(lm, "HEAD_BITS", 6)
    monkeypatch.setattr(lm, "REMEMBERED", 500)
    rest = remainder(F.col("doc_id"), 10)
    for df in (docs.select("doc_id", "text").limit(60), odd.select("doc_id", "text")):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        trains = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 10 != 0
        words = lambda t: [*(t or "").encode().lower().split(), None]
        c = Counter(w for i, t in rows if trains(i) for w in words(t))
        n, v = sum(c.values()), len(c)
        want = Counter()
        for i, t in rows:
            w = words(t)
            want[i, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4)] += 1
        for most in (1 << 30, 40_000):  # the smaller one deals texts over several groups
            monkeypatch.setattr(lm, "GROUP_BYTES", most)
            found = lm.score(df, [F.col("doc_id"), F.lit("kept").alias("_text"), F.lit(1).alias("score")], "text", rest != 0, rest == 9, F.col("doc_id")).collect()
            assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found) == want
            assert all(r.score < 0 and r._text == "kept" for r in found)
            same = defaultdict(set)
            for r in found:
                same[dict(rows)[r.doc_id]].add(round(r.score, 3))
            assert all(len(x) == 1 for x in same.values())
    assert lm.score(none, [F.col("doc_id")], "text", rest != 0, rest == 9, F.col("doc_id")).count() == 0
    even = lm.score(docs.limit(3), [F.octet_length("text").alias("b")], "text", F.lit(False), F.lit(False), F.col("doc_id")).collect()
    assert all(abs(r.score + (r.b + 1) * 8 * math.log10(2)) < 1e-3 * r.b for r in even)


def test_scores_do_not_depend_on_how_rows_are_dealt(spark, docs):
    rest = remainder(F.col("doc_id"), 10)
    found = []
    for n in (1, 6):
        rows = lm.score(docs.select("doc_id", "text").repartition(n), [F.col("doc_id")], "text", rest != 0, rest == 9, F.col("doc_id")).collect()
        found.append({r.doc_id: r.score for r in rows})
    assert found[0].keys() == found[1].keys()
    assert all(abs(found[0][i] - found[1][i]) < 1e-4 * abs(found[0][i]) for i in found[0])


def test_scores_are_those_of_one_model_whatever_the_size(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(12)]
    df = spark.createDataFrame([(i, " ".join(rng.choice(words, 20))) for i in range(160)], "doc_id long, text string")
    scores = lambda: {r.doc_id: r.score for r in lm.score(df, [F.col("doc_id")], "text", F.col("doc_id") % 10 != 0, F.col("doc_id") % 10 == 9, F.col("doc_id")).collect()}
    monkeypatch.setattr(lm, "BELOW", (-5, -6, -7, -9))  # hardly any contexts share slots
    want = scores()
    monkeypatch.setattr(lm, "GROUP_BYTES", 4000)
    got = scores()
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 0.003 * abs(want[i]) for i in want)


def test_scores_by_sections_are_those_by_whole_tables(spark, docs, odd, monkeypatch):
    rest = remainder(F.col("doc_id"), 10)
    scores = lambda df: {r.doc_id: r.score for r in lm.score(df, [F.col("doc_id")], "text", rest != 0, rest == 9, F.col("doc_id")).collect()}
    tables = (docs.select("doc_id", "text").limit(120).localCheckpoint(), odd.select("doc_id", "text"))
    whole = [scores(df) for df in tables]
    monkeypatch.setattr(lm, "WHOLE", 0)
    monkeypatch.setattr(lm, "PIECE", 500)
    monkeypatch.setattr(lm, "LOOK_BYTES", 30_000)
    for df, want in zip(tables, whole, strict=True):
        got = scores(df)
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) <= 1e-5 * abs(want[i]) for i in want)


def test_sections_hold_the_counts_of_all_windows(spark, monkeypatch):
    monkeypatch.setattr(lm, "PIECE", 50)
    texts = [f"row {i % 7} of the {i % 5} tables, {i}" for i in range(300)]
    df, bits, sections = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), lm.table_bits(4000), 4
    slots = lm.Slots(bits)
    windows, times = np.unique(lm.packed([t.encode() for t in texts]), return_counts=True)
    own = lm.section_of(windows, sections)
    assert len(set(own.tolist())) == sections and (lm.section_of(windows, 1) == 0).all()
    assert (own == lm.section_of(windows & np.uint64(0xFFFF00), sections)).all()
    want = np.zeros((sections, 2 * slots.total), np.uint64)
    for s in range(sections):
        lm.add_counts(want[s], slots, lm.rows_of(windows[own == s]), times[own == s])
    got = np.zeros_like(want).reshape(-1, 2 << lm.BLOCK_BITS)
    for r in lm.count_sections(df, "text", 0, bits, sections).collect():
        got[r.block] += lm._unpacked(bytes(r.counts))
    assert (got.ravel() == want.ravel()).all()
    monkeypatch.setattr(lm, "GROUP_BYTES", 100)
    assert [lm.sections_for(n) for n in (0, 1, 100, 101, 200, 201, 400, 401)] == [1, 1, 1, 2, 2, 4, 4, 8]


def _plain_mixer(learned, dev, texts, bits):
    """The model one bit at a time: slots in a dictionary by the same hash, learning and refinement as stated."""
    slots = lm.Slots(bits)

    def steps(t):
        past = bytes([lm.EDGE]) * lm.REACH
        for byte in [*t, lm.EDGE]:
            window = int.from_bytes(past[-lm.REACH :] + bytes([byte]), "big")
            yield window, byte, past[-1]
            past += bytes([byte])

    def places(window, byte):
        rows = lm.rows_of(np.array([window], np.uint64))
        hashes = lm.context_hashes(rows)
        for bit in range(8):
            node = np.array([(1 << bit) | (byte >> (8 - bit))], np.uint32)
            yield bit, (byte >> (7 - bit)) & 1, [int(slots.at(h, node, i)[0]) for i, h in enumerate(hashes)]

    def counted(ts):
        c = defaultdict(lambda: [0, 0])
        for t in ts:
            for w, b, _ in steps(t):
                for _, one, at in places(w, b):
                    for a in at:
                        c[a][one] += 1
        return c

    def stretch(c, a):
        zeros, ones = c[a] if a in c else (0, 0)
        return max(-127, min(127, round(math.log((ones + lm.COUNT_PRIOR) / (zeros + lm.COUNT_PRIOR)) * lm.LEVELS))) / lm.LEVELS

    def mixed(c, weights, bit, at):
        x = [*(stretch(c, a) for a in at), 1.0]
        gate = bit
        for long in (x[-2], x[-3]):
            gate = gate * 4 + sum(abs(long) > s for s in lm.SURER)
        return x, gate, sum(weights[k][gate] * v for k, v in enumerate(x))

    sigmoid = lambda z: 1 / (1 + math.exp(-max(-lm.MOST_ODDS, min(lm.MOST_ODDS, z))))
    part, whole = counted(learned), counted([*learned, *dev])
    mixer = lm.Mixer(bits, np.zeros(slots.total, np.int8), lm._start_weights())
    for a in part:
        mixer.odds[a] = round(stretch(part, a) * lm.LEVELS)
    rows, times = lm.distinct(dev)
    mixer.learn(rows, times)  # the order of online steps is the learner's own
    weights = mixer.weights.astype(float)
    centre = np.tile(np.linspace(-8, 8, lm.BUCKETS), 256)
    seen = [20 * (1 - 1 / (1 + np.exp(-centre))), 20 / (1 + np.exp(-centre))]
    where = lambda z: (max(-7.99, min(7.99, z)) + 8) * (lm.BUCKETS - 1) / 16
    for t in dev:
        for w, b, last in steps(t):
            for bit, one, at in places(w, b):
                p = where(mixed(part, weights, bit, at)[2])
                seen[one][last * lm.BUCKETS + int(p)] += 1 - p % 1
                seen[one][last * lm.BUCKETS + int(p) + 1] += p % 1
    refined = np.log(seen[1] / seen[0])
    out = []
    for t in texts:
        total = 0.0
        for w, b, last in steps(t):
            for bit, one, at in places(w, b):
                z = mixed(whole, weights, bit, at)[2]
                p = where(z)
                r = (1 - p % 1) * refined[last * lm.BUCKETS + int(p)] + p % 1 * refined[last * lm.BUCKETS + int(p) + 1]
                one_p = (sigmoid(z) + 1 / (1 + math.exp(-r))) / 2
                total += math.log10(one_p if one else 1 - one_p)
        out.append(total)
    return out


def test_score_is_that_of_a_plain_bit_mixer(spark):
    texts = ["the cat sat on the mat", "a cat ran to the mat and sat", None, "", "dogs and cats, the end", "the mat", "the cat sat on the mat", "zebra"] * 3
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    raw = lambda keep: [(t or "").encode() for i, t in rows if keep(i % 5)]
    got = lm.score(df, [F.col("doc_id")], "text", F.col("doc_id") % 5 != 0, F.col("doc_id") % 5 == 4, F.col("doc_id")).collect()
    train = raw(lambda r: r != 0)
    want = _plain_mixer(raw(lambda r: r not in (0, 4)), raw(lambda r: r == 4), [(t or "").encode() for _, t in rows], lm.table_bits(sum(len(t) + 1 for t in train)))
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.score - want[r.doc_id]) < 2e-3 * max(1, abs(want[r.doc_id])), (texts[r.doc_id], r.score, want[r.doc_id])


def test_mixer_gives_a_distribution():
    """Probabilities of all bytes after a context sum to one, and learning makes seen text shorter."""
    texts = [b"the cat sat on the mat and the cat ran"] * 5
    bits = lm.table_bits(1 << 20)
    counts = lm.Counts(lm.Slots(bits))
    rows, times = lm.distinct(texts)
    assert times.sum() == sum(map(len, texts)) + len(texts)
    lm.add_counts(counts.table, counts.slots, rows, times)
    mixer = lm.Mixer(bits, lm.odds(counts.table), lm._start_weights())
    before = mixer.scores(texts).sum()
    mixer.learn(rows, times)
    assert mixer.scores(texts).sum() > before
    mixer.refined = np.tile(np.linspace(-8, 8, lm.BUCKETS), 256).astype(np.float32)
    some = np.zeros(256, np.uint64) + int.from_bytes(b"e cat"[-lm.REACH :], "big") * 256 + np.arange(256, dtype=np.uint64)
    assert abs((10.0 ** mixer.cost(some)).sum() - 1) < 1e-3
    whole = mixer.scores([b"the cat", b"", b"dog"])
    assert np.allclose(whole, [mixer.scores([t])[0] for t in (b"the cat", b"", b"dog")], atol=1e-4)


def test_memory_changes_no_count_and_no_cost(monkeypatch):
    """With a memory of few places, windows give way all the time; counts and costs stay those of a plain sum."""
    monkeypatch.setattr(lm, "MEMORY_BITS", 5)
    rng = np.random.default_rng(14)
    chunks = [[bytes(rng.choice(list(b"abc "), rng.integers(0, 60)).astype(np.uint8)) for _ in range(9)] for _ in range(6)]
    bits = lm.table_bits(4000)
    counts, plain = lm.Counts(lm.Slots(bits)), np.zeros(2 * lm.Slots(bits).total, np.uint32)
    for c in chunks:
        counts.add(lm.packed(c))
        lm.add_counts(plain, counts.slots, *lm.distinct(c))
    got = np.zeros_like(plain).reshape(-1, 2 << lm.BLOCK_BITS)
    for i, raw in counts.blocks():
        got[i] = lm._unpacked(raw)
    assert (got.ravel() == plain).all()
    mixer, memory = lm.Mixer(bits, lm.odds(plain), lm._start_weights()), lm.Memory(np.float32)
    for c in chunks:
        assert np.allclose(mixer.scores(c, memory), mixer.scores(c), atol=1e-4)


def test_blocks_of_many_tasks_are_summed_in_two_steps(spark):
    rng = np.random.default_rng(15)
    parts = [(int(i % 3), int(i % 2), rng.integers(0, 2**32, 2 << lm.BLOCK_BITS, dtype=np.uint32)) for i in range(24)]
    want = defaultdict(lambda: np.zeros(2 << lm.BLOCK_BITS, np.uint64))
    for block, kind, counts in parts:
        want[block, kind] += counts
    import zstandard

    df = spark.createDataFrame([(b, k, bytearray(zstandard.compress(c.tobytes()))) for b, k, c in parts], "block int, kind int, counts binary")
    for tasks in (1, 1000):  # sums go over 32 bits
        found = lm.sum_blocks(df, tasks).collect()
        assert len(found) == 6 and all((lm._unpacked(bytes(r.counts)) == want[r.block, r.kind]).all() for r in found)


def _five_word_sets(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _kept_by_hand(rows, similarity=0.8):
    sets, parent = [_five_word_sets(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both * 5 >= 4 * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return [i for n, (i, _) in enumerate(rows) if find(n) == n]


def test_near_duplicates_are_those_of_exact_jaccard(spark, docs):
    """Pairs on both sides of 0.8, of few and of many shingles, and the test table, against all pairs by hand."""
    rng = np.random.default_rng(12)
    words = lambda n: ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n)]
    texts = []
    for k in (4, 5, 6, 8, 13, 20, 28, 60, 450):  # shingles in the first text; one of the pair has `more` shingles of its own
        for more in {1, round(k * 0.16), round(k * 0.2), k // 4, k // 4 + 1, round(k * 0.3)}:
            for _ in range(4):
                base = words(k + 4)
                texts += [" ".join(base), " ".join(base + words(more))]
        base, side = words(k + 4), max(1, k // 9)
        texts += [" ".join(base + words(side)), " ".join(words(side) + base)]
    rows = list(enumerate(texts))
    want = _kept_by_hand(rows)
    kept = simhash_wide.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert 0.5 * len(rows) < len(want) < 0.9 * len(rows)
    assert sorted(r.doc_id for r in kept.collect()) == want
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert sorted(r.doc_id for r in simhash_wide.drop_near_duplicates(docs).collect()) == _kept_by_hand(rows)


def test_near_duplicates_among_a_common_passage_and_a_large_family(spark, monkeypatch):
    """Many texts meet at the shingles of one passage, and a family of edits of one text is larger than a group that is measured."""
    monkeypatch.setattr(simhash_wide, "BLOCK", 8)
    rng = np.random.default_rng(16)
    words = lambda n: ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n)]
    passage, texts = words(40), []
    for _ in range(60):
        own = words(int(rng.integers(5, 30)))
        texts.append(" ".join(own + passage))
        if rng.random() < 0.3:
            texts.append(" ".join(own + passage + words(int(rng.integers(1, 12)))))
    base = words(120)
    for _ in range(70):
        edited = list(base)
        for at in rng.choice(120, int(rng.integers(1, 4)), replace=False):
            edited[at] = words(1)[0]
        texts.append(" ".join(edited))
    rows = list(enumerate(texts))
    kept = simhash_wide.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == _kept_by_hand(rows)


def test_near_duplicates_leave_nothing_large_on_the_disk(spark, docs, monkeypatch):
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    began = files()
    staged(docs.repartition(3, "lang").select("doc_id"), "dealt")
    assert files() <= began  # shuffle files go with their query
    paths, real = {}, simhash_wide.staged

    def recorded(df, name):
        out = real(df, name)
        paths.setdefault(name, []).append(out._staged_at.replace("file://", ""))
        return out

    monkeypatch.setattr(simhash_wide, "staged", recorded)
    simhash_wide.drop_near_duplicates(docs).count()
    assert len(paths["wide-met"]) == simhash_wide.PASSES and Path(paths["wide-marks"][0]).exists()
    gone = ("wide-common", "wide-names", "wide-prints", "wide-groups", "wide-met", "wide-passed", "wide-verified", "wide-roots")
    assert not any(Path(p).exists() for name in gone for p in paths[name])


def test_sets_that_share_a_node_are_told_apart(spark):
    rows, moved = simhash_wide.apart(spark.createDataFrame([(1, 7, "a"), (1, 9, "b"), (1, 7, "c"), (2, 7, "d")], "node long, check long, x string"))
    got = {r.x: r.node for r in rows.collect()}
    assert got["a"] == got["c"] == 1 and got["d"] == 2 and got["b"] not in (1, 2) and moved == {(1, 9): got["b"]}


def test_near_duplicates_keep_columns_of_any_name(spark):
    rows = [(1, "one two three four five six", 5, "k", 3.0), (2, "one two three four five six", 6, "l", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _mark int, `_kept` string, `size.x` double")
    kept = simhash_wide.drop_near_duplicates(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == rows[:1]


def test_sketches_leave_out_no_alike_sets():
    rng = np.random.default_rng(13)
    for n in (0, 1, 5, 40, 900):
        for m in (n, n + 1, n + n // 5, 2 * n):
            a = rng.integers(0, 2**63, max(n, m), dtype=np.uint64)
            b = np.concatenate([a[: m - m // 10], rng.integers(0, 2**63, m // 10, dtype=np.uint64)])
            differ = len(np.setxor1d(a[:n], b))
            assert simhash_wide.least_difference(simhash_wide.sketch(a[:n]), simhash_wide.sketch(b)) <= differ


def test_a_language_of_long_texts_only_is_learned(spark):
    texts = [("aa", "the water of the river runs to the sea é " * 200), ("bb", "der Fluss trägt sein Wasser in das Meer " * 200)] * 3
    known = langid.fit(spark.createDataFrame([(i, t, name) for i, (name, t) in enumerate(texts)], "doc_id long, text string, lang string"), F.lit(True))
    assert set(known) == {"aa", "bb"} and all(0 < len(x) <= 3 * (langid.SAMPLE_TEXT + 1) and x.decode() for x in known.values())
    assert [langid.decide(t, langid._encoders(known))[0] for _, t in texts] == [name for name, _ in texts]
