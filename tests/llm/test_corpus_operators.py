"""Operators that compare rows: suffix dedup, fingerprints, token counts, n-gram join, WARC,
decontamination, connected components, and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from sensortwin.llm import common, decontam, fingerprints, ngram_join, suffix_dedup, token_counts, warc
from sensortwin.session import scratch_path

from .helpers import awkward, documents, edited, prose


# -- components -------------------------------------------------------------------------------
@pytest.mark.parametrize("one_task", [0, 300_000])
def test_components_equal_union_find(spark, monkeypatch, one_task):
    monkeypatch.setattr(common, "EDGES_PER_TASK", one_task)  # 0: by rounds alone
    r = random.Random(1)
    edges = [(r.randrange(150), r.randrange(150)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(40)] + [(7, 7), (None, 3), (999, 999)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {x["node"]: x["root"] for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(up)}


# -- suffix arrays ----------------------------------------------------------------------------
def test_suffix_arrays_and_prefixes_equal_sorting():
    r = random.Random(1)
    for _ in range(1500):
        s = np.array([r.randrange(r.choice([1, 2, 3, 250])) for _ in range(r.randrange(1, 60))], np.uint8)
        want = sorted(range(len(s)), key=lambda i: bytes(s[i:]))
        assert suffix_dedup.suffix_array(s).tolist() == want
        assert suffix_dedup.suffix_array(s.astype(np.int64) + 4096).tolist() == want
        sa, got = np.array(want), suffix_dedup.common_prefixes(s, np.array(want), 10)
        for x, y in zip(sa[:-1], sa[1:], strict=True):
            n = 0
            while n < 10 and max(x, y) + n < len(s) and s[x + n] == s[y + n]:
                n += 1
            assert got[y] == n


def plain_dedup(rows, length):
    seen, out = set(), {}
    docs = sorted({(i is not None, i or 0, suffix_dedup.digest64((t or "").encode()), (t or "").encode()) for i, t in rows})
    for has, i, _, b in docs:
        m = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                m[k : k + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, y in zip(b, m, strict=True) if not y)
        runs = sum(1 for k in range(len(m)) if m[k] and (not k or not m[k - 1]))
        out[i if has else None, b] = (len(b), sum(m), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_equals_brute_force(spark, monkeypatch):
    passage = prose(90, 40)
    _, rows = awkward(spark)
    rows = [r for r in rows if r[0] != 7] + [(20 + k, prose(100 + k, 20) + passage[k : 150 + k] + prose(200 + k, 20)) for k in range(12)]
    rows += [(60, "ab" * 200), (61, "x" * 500), (62, passage + passage), (2, "other text " + passage), (None, passage)]
    docs = documents(spark, rows)
    want = sorted((i or -1, *x) for (i, b), x in plain_dedup(rows, 100).items() for j, t in rows if (j, (t or "").encode()) == (i, b))
    for hot in (20_000, 3):  # also with hot anchor hashes shared out by their strings
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        got = suffix_dedup.digest(suffix_dedup.dedup(docs)).collect()
        assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    assert suffix_dedup.dedup(docs.limit(0)).count() == 0


# -- fingerprints -----------------------------------------------------------------------------
def jaccard(a, b, n=5):
    def s(t):
        w = t.lower().split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    a, b = s(a), s(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_estimate_jaccard(spark):
    rows = [(i, prose(i, 300)) for i in range(30)] + [(100 + i, edited(prose(i, 300), i, 1 + i // 2)) for i in range(30)]
    docs = fingerprints.fingerprint(documents(spark, rows)).collect()
    text, fp = {r["doc_id"]: r["text"] for r in docs}, {r["doc_id"]: r["fingerprint"] for r in docs}
    pairs = spark.createDataFrame([(fp[i], fp[100 + i], jaccard(text[i], text[100 + i])) for i in range(30)], "a string, b string, j double")
    errors = [abs(r["l"] - r["j"]) for r in pairs.select("j", fingerprints.likeness(pairs.a, pairs.b).alias("l")).collect()]
    assert sum(errors) / len(errors) < 0.05 and max(errors) < 0.16


def test_compare_with_next(spark):
    docs, rows = awkward(spark)
    out = fingerprints.compare_with_next(docs).collect()
    assert len(out) == len(rows)
    ids = sorted({i for i, _ in rows if i is not None}, reverse=True) + [None]
    best = {i: max((t or "") for j, t in rows if j == i) for i in ids}
    for r in out:
        nxt = best[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
        if r["doc_id"] is None or r["doc_id"] == 2:
            continue
        t = best[r["doc_id"]]
        half = len(t) // 2
        changed = t[: len(t) - half] + nxt[:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
    by = defaultdict(set)
    for i, r in ((r["doc_id"], r) for r in out):
        by[best[i] if i is not None else i].add(r["fingerprint"])
    assert all(len(v) == 1 for k, v in by.items() if k is not None)
    assert {r["fingerprint"] for r in out if r["doc_id"] in (3, 4, 5)} == {""}
    assert fingerprints.compare_with_next(docs.limit(0)).count() == 0


# -- token counts -----------------------------------------------------------------------------
def test_token_counts_over_small_blocks(spark, tmp_path):
    docs, rows = awkward(spark)
    enc = token_counts.encoder()
    want = sorted((i or -1, len(enc.encode_ordinary(t or ""))) for i, t in rows)
    folder = f"file://{tmp_path}/tokens"
    order = token_counts.write_tokens(docs.repartition(3), folder)
    for block in (1, 7, 1000, token_counts.BLOCK_TOKENS) if sum(n for _, n in want) < 3000 else (997, token_counts.BLOCK_TOKENS):
        got = order.join(token_counts.scan(spark, order, folder, block_tokens=block), ["file", "n"]).collect()
        assert sorted((r["id"] or -1, r["n_tokens"]) for r in got) == want
    np.array([5, 6, token_counts.END, token_counts.END, 7, 8, 9], "<u2").tofile(tmp_path / "tail.bin")
    (tmp_path / "empty.bin").write_bytes(b"")
    files = spark.createDataFrame([("tail.bin",), ("empty.bin",)], "file string")
    got = token_counts.scan(spark, files, str(tmp_path), block_tokens=2).orderBy("n").collect()
    assert [(r["n"], r["n_tokens"], r["finished"]) for r in got] == [(0, 2, True), (1, 0, True), (2, 3, False)]
    assert token_counts.write_tokens(docs.limit(0), f"file://{tmp_path}/none").count() == 0


# -- n-gram join ------------------------------------------------------------------------------
def plain_join(rows, n, t):
    sets = {}
    for k, (_, text) in enumerate(rows):
        w = (text or "").encode().lower().split()
        sets[k] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    groups = defaultdict(list)
    for k in sets:
        groups[find(k)].append(rows[k][0])
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [x for x in groups[find(k)] if x is not None]
        out.append((i if i is not None else -1, len(sets[k]), (min(ids) if ids else -1) if sets[k] else (i if i is not None else -1)))
    return sorted(out)


@pytest.mark.parametrize(("n", "t"), [(3, Fraction(9, 10)), (5, Fraction(8, 10))])
def test_ngram_join_equals_all_pairs(spark, monkeypatch, n, t):
    monkeypatch.setattr(ngram_join, "CHUNK", 4)  # groups then span several chunks
    _, rows = awkward(spark)
    rows = [r for r in rows if r[0] != 7] + [(None, prose(6, 80)), (None, prose(77, 60)), (700, "a b c d"), (701, "A b  c D"), (702, "a b c e")]
    for g in range(6):
        base = prose(500 + g, 40 + 45 * g)
        rows += [(1000 + 100 * g + k, edited(base, 10_000 + 31 * g + k, k % 5)) for k in range(9)]
    chain = prose(900, 200)
    for k in range(8):  # each links with the next, the ends not with each other
        rows.append((5000 + k, chain))
        chain = edited(chain, 950 + k, 2)
    random.Random(1).shuffle(rows)
    got = ngram_join.join(documents(spark, rows).repartition(3), n=n, similarity=t).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1)
                  for r in got) == plain_join(rows, n, t)


def test_ngram_join_sends_near_sets_only_and_removes_its_tables(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 4)
    monkeypatch.setattr(ngram_join, "CHUNK_PAIRS", 1)
    shared = prose(42, 120)
    rows = [(k, shared + " " + prose(100 + k, 60)) for k in range(60)]  # share keys, but no two are linked
    rows += [(900, edited(rows[7][1], 1, 1))]
    sent, stored, clear = [], [], common.Scratch.clear

    def look(self):
        sent.extend(spark.read.parquet(f).count() for f in self.folders if "ngram-set-" in f)
        stored.extend(self.folders)
        clear(self)

    monkeypatch.setattr(common.Scratch, "clear", look)
    got = ngram_join.join(documents(spark, rows).repartition(3), n=5, similarity=0.8)
    assert sent and max(sent) < 20
    left = [f for f in stored if spark._jvm.java.io.File(f.removeprefix("file:")).exists()]
    assert any("ngram-chunks" in f for f in stored) and not left
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == plain_join(rows, 5, Fraction(8, 10))


def test_linked_sets_always_share_a_key():
    r = np.random.default_rng(0)
    for t in (Fraction(9, 10), Fraction(8, 10)):
        bands, tried = ngram_join.Bands(t), 0
        for _ in range(600):
            s = np.unique(r.integers(0, 2**63, int(np.exp(r.uniform(0, 7)))).astype(np.uint64))
            d = int(2 * len(s) * bands.c)
            gone = int(r.integers(0, d + 1))
            y = np.unique(np.r_[s[r.permutation(len(s))[gone:]], r.integers(0, 2**63, int(r.integers(0, d - gone + 1))).astype(np.uint64)])
            if len(y) and bands.linked(s, y) and not np.array_equal(s, y):
                tried += 1
                assert len(np.intersect1d(bands.keys(s), bands.keys(y)))
        assert tried > 200


def test_keys_that_linked_sets_keep_meet_in_any_order(monkeypatch):
    """However keys are ranked, and whatever other sets share, the keys that count of two linked sets have one in common."""
    r = np.random.default_rng(1)
    for sketches, spare in ((ngram_join.SKETCHES, ngram_join.SPARE), (1, 0.0), (2, 0.05)):  # so few that sets run out of sketches
        monkeypatch.setattr(ngram_join, "SKETCHES", sketches)
        monkeypatch.setattr(ngram_join, "SPARE", spare)
        for t in (Fraction(9, 10), Fraction(8, 10)):
            bands, tried, several = ngram_join.Bands(t), 0, 0
            for _ in range(400):
                s = np.unique(r.integers(0, 2**63, int(np.exp(r.uniform(1, 7)))).astype(np.uint64))
                d = int(2 * len(s) * bands.c)
                gone = int(r.integers(0, d + 1))
                y = np.unique(np.r_[s[r.permutation(len(s))[gone:]], r.integers(0, 2**63, d - gone).astype(np.uint64)])
                if not bands.linked(s, y) or np.array_equal(s, y):
                    continue
                both, salt, kept = np.intersect1d(bands.keys(s), bands.keys(y)), np.uint64(r.integers(0, 2**63)), []
                for x in (s, y):
                    mine = []
                    for need, keys in bands.sketches(x):
                        shared = keys[np.isin(keys, both) | (r.random(len(keys)) < 0.2)]  # with the other one, or a third set
                        mine.append(shared[np.argsort(ngram_join.mix(shared ^ salt))][: max(0, len(shared) - need + 1)])
                        several += need > 1
                    kept.append(np.concatenate(mine))
                tried += 1
                assert len(np.intersect1d(*kept))
            assert tried > 100 and several > 20


def test_frequent_phrases_do_not_tie_unrelated_sets_together(spark, monkeypatch):
    r = random.Random(3)
    phrases = [prose(8000 + k, 5) for k in range(12)]
    rows = []
    for k in range(150):  # all hold the same phrases among words of their own
        words = [prose(9000 + 20 * k + i, 8) for i in range(12)]
        rows.append((k, " ".join(f"{a} {b}" for a, b in zip(words, r.sample(phrases, 12), strict=True))))
    rows += [(900 + k, edited(rows[k][1], k, 1)) for k in range(5)]
    met, clear = [], common.Scratch.clear

    def look(self):
        met.extend(spark.read.parquet(f).count() for f in self.folders if "ngram-nodes-" in f)
        clear(self)

    monkeypatch.setattr(common.Scratch, "clear", look)
    got = ngram_join.join(documents(spark, rows).repartition(3), n=5, similarity=0.8).collect()
    assert len(met) == 1 and 10 <= met[0] < 30
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_join(rows, 5, Fraction(8, 10))


@pytest.mark.parametrize("cost", [-1e9, 1e9])
def test_groups_are_compared_by_key_or_as_a_whole(spark, monkeypatch, cost):
    monkeypatch.setattr(ngram_join, "CHUNK", 4)
    monkeypatch.setattr(ngram_join, "ROW_COST", cost)
    shared, rows = prose(42, 120), []
    for k in range(25):
        text = shared + " " + prose(100 + k, 60)
        rows += [(k, text), (500 + k, edited(text, k, 2)), (None, edited(text, 70 + k, 3))]
    chain = prose(900, 200)
    for k in range(12):  # each links with the next, the ends not with each other
        rows.append((5000 + k, chain))
        chain = edited(chain, 950 + k, 2)
    random.Random(2).shuffle(rows)
    made, clear = {}, common.Scratch.clear

    def look(self):
        made.update({name: spark.read.parquet(f).count() for f in self.folders for name in ("ngram-sized", "ngram-together") if f"{name}-" in f})
        clear(self)

    monkeypatch.setattr(common.Scratch, "clear", look)
    got = ngram_join.join(documents(spark, rows).repartition(3), n=5, similarity=0.8).collect()
    assert made["ngram-together"] > made["ngram-sized"] if cost < 0 else made["ngram-together"] <= made["ngram-sized"]
    want = plain_join(rows, 5, Fraction(8, 10))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1) for r in got) == want


@pytest.mark.parametrize("broadcast", [True, False])
def test_rows_that_share_an_id_link_by_their_own_text(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    rows = []
    for k in range(12):  # each id holds two texts; the second is a near copy of another document
        base = prose(3000 + k, 90)
        rows += [(1000 + k, prose(4000 + k, 70)), (1000 + k, edited(base, k, 1)), (500 + k, base), (None, edited(base, 50 + k, 1))]
    got = ngram_join.join(documents(spark, rows).repartition(4), n=5, similarity=0.8).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"]) for r in got) == plain_join(rows, 5, Fraction(8, 10))
    linked = [r for r in got if r["doc_id"] is not None and r["doc_id"] >= 1000 and r["component_id"] < 1000]
    assert len(linked) == 12


def kept_texts(rows, n=5, t=Fraction(8, 10)):
    """One text of each component by plain counting: the smallest id, none last; then any of that id."""
    comp = defaultdict(list)
    sets = [(i, x, frozenset(zip(*[(w := (x or "").lower().split())[k:] for k in range(n)])) or frozenset([tuple(w)] if w else [])) for i, x in rows]
    name = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a][2] and sets[b][2] and len(sets[a][2] & sets[b][2]) >= t * len(sets[a][2] | sets[b][2]):
                old, new = name[a], name[b]
                name = [new if x == old else x for x in name]
    for k, (i, x, s) in enumerate(sets):
        comp[name[k] if s else ("empty", k)].append((i is None, i, x))
    return [(min(m, key=lambda r: (r[0], r[1] or 0))[:2], {r[2] for r in m if r[:2] == min(m, key=lambda r: (r[0], r[1] or 0))[:2]}) for m in comp.values()]


@pytest.mark.parametrize("broadcast", [True, False])
def test_representatives_keep_one_of_each_group_in_any_order(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    docs, rows = awkward(spark)
    rows = [r for r in rows if r[0] != 7]
    two, unique = prose(70, 60), prose(71, 60)
    rows += [(50, two), (51, edited(two, 1, 1)), (51, unique), (None, two.upper()), (None, prose(72, 40)), (None, prose(72, 40)), (60, unique + " x"), (50, two)]
    seen = []
    for order in (rows, rows[::-1]):
        kept = ngram_join.representatives(documents(spark, order).repartition(3))
        assert kept.columns == docs.columns
        seen.append(sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect()))
    assert seen[0] == seen[1]
    want = kept_texts(rows)
    assert len(seen[0]) == len(want)
    left = list(seen[0])
    for (none, i), texts in want:
        hit = next(x for x in left if x[:2] == (none, i or 0) and x[2] in {t or "" for t in texts})
        left.remove(hit)
    assert not left
    assert ngram_join.representatives(docs.limit(0)).count() == 0 and ngram_join.join(docs.limit(0)).count() == 0


# -- WARC -------------------------------------------------------------------------------------
def test_warc_round_trip_and_lookup(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    html = ["<p>a", "<p>b", None, "", "<p>a", "é\r\n\r\nWARC/1.1" * 50]
    rows = [(i, f"http://h{i % 4}.example.com/p{i % 5}?q={i % 2}", html[i % 6]) for i in range(40)]
    rows += [(3, rows[3][1], rows[3][2]), (None, None, "<p>a"), (99, "http://[bad", "only\none"), (100, "no host", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    folder = f"file://{tmp_path}/warc"
    master = warc.write_index(warc.write_archive(pages, folder), folder)
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        first[b] = min(first.get(b, 10**9), 10**9 if i is None else i)
    got = warc.read_archive(spark, folder, master).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for r in got:
        by_id[r["page_id"]].append(r)
    for i, _, h in rows:
        b = (h or "").encode()
        for r in by_id[i]:
            assert r["payload_bytes"] == len(b) and r["payload_digest"] == base64.b32encode(hashlib.sha1(b).digest()).decode()
        kinds = sorted(r["record_type"] for r in by_id[i])
        if i == first[b]:
            assert kinds == (["response", "revisit"] if i == 3 else ["response"])
            assert [bytes(r["payload"]) for r in by_id[i] if r["record_type"] == "response"] == [b]
        else:
            assert set(kinds) == {"revisit"} and {r["refers_to"] for r in by_id[i]} == {first[b]}
    wanted = {warc.url_key(rows[7][1]), warc.url_key(rows[12][1]), "com,example,nowhere)/", ""}
    found = warc.lookup(spark, folder, master, spark.createDataFrame([(k,) for k in wanted], "key string")).collect()
    assert sorted(r["page_id"] or -1 for r in found) == sorted((i or -1) for i, u, _ in rows if warc.url_key(u) in wanted)
    empty = warc.write_index(warc.write_archive(pages.limit(0), folder + "0"), folder + "0")
    assert warc.read_archive(spark, folder + "0", empty).count() == 0


def test_warc_query_reads_back_by_bisection(spark, tmp_path, monkeypatch):
    from sensortwin.llm import queries

    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    rows = [(i, [None, "", "http://a.org/hot", f"http://b.org/{i % 9}", f"http://c{i}.org/é"][i % 5], f"<p>{i}") for i in range(120)] + [(None, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(warc, "read_archive", None)
    got = queries.op9_warc(spark, str(tmp_path)).collect()
    assert sorted(r["page_id"] if r["page_id"] is not None else -1 for r in got) == [-1, *range(120)]


def test_url_keys():
    assert warc.url_key("http://www.Example.com:80/a?b=1#c") == "com,example,www)/a?b=1"
    assert warc.url_key("https://example.com:8443") == "com,example:8443)/"
    assert warc.url_key(None) == warc.url_key("") == ""


# -- decontamination --------------------------------------------------------------------------
def levenshtein_in(item, doc):
    prev = [0] * (len(doc) + 1)
    for i, w in enumerate(item, 1):
        cur = [i]
        for j, x in enumerate(doc, 1):
            cur.append(min(prev[j - 1] + (w != x), prev[j] + 1, cur[j - 1] + 1))
        prev = cur
    return min(prev)


def test_edit_distance_equals_plain_dynamic_programming():
    r = random.Random(1)
    for _ in range(300):
        a, b = [r.randrange(4) for _ in range(r.randrange(1, 12))], [r.randrange(4) for _ in range(r.randrange(0, 25))]
        d, x, y = decontam.distance_in(np.array(a, np.uint64), np.array(b, np.uint64), 100)
        assert d == levenshtein_in(a, b)
        assert levenshtein_in(a, b[x:y]) == d


def test_decontamination_recall_and_precision(spark):
    r = random.Random(2)
    items = [(i, prose(3000 + i, r.randrange(12, 60))) for i in range(60)] + [(1, prose(3001, 3)), (None, prose(1, 30)), (77, None), (78, ""), (79, "two words")]
    rows, planted = [], set()
    for i in range(200):
        text = prose(7000 + i, r.randrange(30, 200)).split()
        if i % 2:
            k = r.randrange(2, 60)
            words = items[k][1].split()
            gone = edited(items[k][1], i, r.randrange(decontam.allowed(len(words)) + 1)).split()
            p = r.randrange(len(text))
            text[p:p] = gone
            planted.add((i, k))
        rows.append((i, " ".join(text)))
    docs, more = awkward(spark)
    docs = docs.union(documents(spark, [(10_000 + i, t) for i, t in rows]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(x["doc_id"] - 10_000, x["item_id"]): x for x in decontam.find(docs, bench).where("doc_id >= 10000").collect()}
    # every result is right by brute force; nearly all planted ones are found (LSH: target 0.95)
    for (i, k), x in found.items():
        assert levenshtein_in(items[k][1].split(), rows[i][1].split()) == x["distance"] <= decontam.allowed(x["item_words"])
    assert len(planted & set(found)) >= 0.9 * len(planted)
    free = {i for i, _ in rows} - {i for i, _ in found}
    assert free >= {i for i in range(0, 200, 2)}
    clean = decontam.clean(docs, bench)
    # five of the other documents begin with the item that has no id
    assert clean.columns == docs.columns and clean.count() == docs.count() - len({i for i, _ in found}) - 5
    assert decontam.find(docs, bench.limit(0)).count() == 0 and decontam.find(docs.limit(0), bench).count() == 0


# -- pipeline ---------------------------------------------------------------------------------
def test_pipeline_stages_and_result(spark):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "benchmark", "secrets", "bpe"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        after = common.stored(stage(spark, docs, sf), f"test-{name}")
        if name != "bpe":
            assert after.columns == columns
        assert 0 < after.count() <= docs.count()
        docs = after
    assert docs.count() == docs.select("doc_id").distinct().count()
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_every_item_is_searched(spark):
    """Items of one or two words, without an id, and several texts under one id."""
    items = [(1, prose(1, 25)), (1, prose(2, 25)), (None, prose(3, 25)), (4, "Zebra!"), (5, "blue zebra"), (6, ""), (7, None), (8, " . ")]
    rows = [(10, prose(50, 30) + " " + prose(1, 25)), (11, prose(2, 25)), (12, "x " + prose(3, 25) + " y"), (13, "a zebra b"), (14, "so blue, ZEBRA ran"),
            (15, prose(60, 40)), (16, "zebras"), (17, None), (18, "")]
    docs = documents(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontam.find(docs, bench).collect()}
    assert got == {(10, 1, 0), (11, 1, 0), (12, None, 0), (13, 4, 0), (14, 4, 0), (14, 5, 0)}
    assert sorted(r.doc_id for r in decontam.clean(docs, bench).collect()) == [15, 16, 17, 18]


def test_walks_follow_the_recall_asked_for():
    assert decontam.rounds(30, 7) > 64 and decontam.rounds(30, 0) == 1
