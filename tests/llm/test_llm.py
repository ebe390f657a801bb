"""Training-text operators against brute force, exact round trips and hand-made cases."""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clausemill.llm import bpe, fusion, language, lookalikes, neardup, packing, scanned, splitting

CHUNKS = "chunk_id string, text string, defines_terms array<string>, section_title string, key long, n long"


def chunk_rows(spark, rows):
    """Chunks with extra columns whose names clash with those the operators make."""
    return spark.createDataFrame([(i, t, d, None, 1, 2) for i, t, d in rows], CHUNKS)


@pytest.fixture(scope="session")
def ranks():
    return bpe.load_ranks()


# --- 7: encoding ---------------------------------------------------------------------------------------------------


def test_encoding_equals_the_public_library(ranks):
    import tiktoken

    theirs = tiktoken.Encoding("x", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours = bpe.Encoder(ranks)
    rng = random.Random(5)
    pool = [chr(i) for i in (*range(0, 0x260), *range(0x300, 0x460), *range(0x2000, 0x2070), 0x3000, 0x1680, 0x4E00, 0x1F600, 0xFB01, 0xFFFD)] + list("  \n\n'sdt ") * 40
    for _ in range(3000):
        text = "".join(rng.choices(pool, k=rng.randint(0, 30)))
        assert ours.ids(text) == theirs.encode_ordinary(text), repr(text)
    assert ours.ids("<|endoftext|>") == theirs.encode_ordinary("<|endoftext|>")


def test_runs_of_mixed_white_space_stay_whole(ranks):
    import tiktoken

    theirs = tiktoken.Encoding("x", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours = bpe.Encoder(ranks)
    for white in (" \xa0 \xa0 ", " \xa0" * 4, " \xa0" * 8 + " ", "\xa0 ", " \n ", "\n \n", " \u3000 \u3000"):
        for text in (f"1.{white}Definitions", f"the end{white}", f"{white}x y", f"a b{white}c d"):
            assert ours.ids(text) == theirs.encode_ordinary(text), repr(text)


def test_long_words_merge_as_short_ones(ranks):
    rng = random.Random(1)
    for n in (1, 2, 7, 60, 150):
        word = bytes(rng.choices(b"abcdefgh", k=n))
        assert bpe.merge_long(word, ranks) == bpe.merge_short(word, ranks)
    very_long = b"a" * 100_000
    back = {v: k for k, v in ranks.items()}
    assert b"".join(back[i] for i in bpe.merge_long(very_long, ranks)) == very_long


def test_encode_table(spark, ranks):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "Hello world", 9), (3, "Hello world", 9), (4, "x " * 50_000, 9)], "doc_id long, text string, ids long")
    got = sorted((r.doc_id, r.ids) for r in bpe.encode(df).collect())
    assert got[0] == (1, []) and got[1] == (2, []) and got[2] == got[3] == (3, [15496, 995])
    assert len(got[4][1]) > 50_000
    assert bpe.encode(df.limit(0)).collect() == []


# --- 8: packing ----------------------------------------------------------------------------------------------------


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_tokens long")


def test_packing_places_every_token_once(spark, ranks):
    rng = random.Random(2)
    rows = [(i, None if i % 50 == 0 else " ".join(["clause"] * rng.randint(0, 600)), rng.choice(["a", "b", None]), "en", 7) for i in range(400)] + [(400, "word " * 5000, "c", "en", 7)]
    df = documents(spark, rows)
    got = packing.pack(df, group_rows=120).collect()
    sizes = {i: len(bpe.Encoder(ranks).ids(t)) for i, t, *_ in rows}
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(range(401))
    by_doc, by_box = Counter(), {}
    for r in got:
        by_doc[r.doc_id] += r.n_tokens
        by_box.setdefault(r.container_id, []).append((r.at_token, r.n_tokens))
        assert r.piece == 0 or sizes[r.doc_id] > packing.CAPACITY
    assert by_doc == Counter(sizes)
    for items in by_box.values():
        items.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(items, items[1:])) and items[-1][0] + items[-1][1] <= packing.CAPACITY
    assert sum(sizes.values()) > 0.95 * packing.CAPACITY * len(by_box)
    assert packing.pack(df.limit(0)).collect() == []


def test_containers_are_measured_against_the_proportions(spark):
    df = documents(spark, [(i, "clause " * 60, "ab"[i % 4 == 0], "en", 1) for i in range(1200)])
    got = {r.source: r for r in packing.mixture(packing.pack(df, group_rows=300)).collect()}
    assert got["a"].target == 0.75 and got["b"].target == 0.25 and all(r.mean_gap < 0.1 and r.within_tenth > 0.7 for r in got.values())
    assert packing.mixture(packing.pack(df.limit(0))).collect() == []


def test_windows_follow_the_proportions():
    items = [(64, "a")] * 400 + [(64, "b")] * 1200
    placed = packing.fill(items, 1024, {"a": 0.25, "b": 0.75}, {})
    windows = Counter((w, items[i][1]) for i, w, _ in placed)
    assert all(3 <= windows[w, "a"] <= 5 for w in range(90))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 100), st.sampled_from("abc")), max_size=60))
def test_fill_never_overflows(items):
    placed = packing.fill(items, 100, {"a": 0.2, "b": 0.3, "c": 0.5}, {"a": -40.0})
    assert sorted(i for i, _, _ in placed) == list(range(len(items)))
    used = Counter()
    for i, w, at in placed:
        assert at == used[w]
        used[w] += items[i][0]
    assert all(n <= 100 for n in used.values())


# --- 5: splitting --------------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab .\n\r\té😀"), max_size=400), st.integers(20, 60), st.integers(0, 12))
def test_pieces_give_the_text_back(text, limit, overlap):
    got = splitting.cut(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (_, end, strength), (start, _, _) in zip(got, got[1:]):
        assert start == max(0, end - overlap)
        assert strength == 0 or text[end - 1].isspace()
    assert all(0 <= e - s <= limit for s, e, _ in got)
    assert "".join(text[(s + overlap if k and s + overlap <= e else s) if k else 0 : e] for k, (s, e, _) in enumerate(got)) == text or all(got[k][1] >= got[k - 1][1] for k in range(1, len(got)))


def test_weak_boundaries_are_merged_first():
    text = "One. Two.\nThree.\n\n" + "Four five six. " * 3
    ends = [text[a:b] for a, b, _ in splitting.cut(text, 40, 0)]
    assert ends[0].endswith("\n\n")


def test_split_table(spark):
    df = chunk_rows(spark, [("a", "x" * 4000, None), ("b", "y" * 9000, None), ("b", "y" * 9000, None), ("c", None, None), (None, "z" * 5000, None), ("d", "wort und " * 900, [])])
    got = splitting.split_oversized(df).collect()
    assert {r.chunk_id for r in got} == {"b", "d"}
    for c in ("b", "d"):
        rows = sorted((r for r in got if r.chunk_id == c), key=lambda r: r.part)
        assert [r.part for r in rows] == list(range(1, len(rows) + 1)) and all(r.num_parts == len(rows) and len(r.text) <= 4000 for r in rows)
        assert rows[0].text + "".join(r.text[200:] for r in rows[1:]) == ("y" * 9000 if c == "b" else "wort und " * 900)
        assert all(x.text[-200:] == y.text[:200] for x, y in zip(rows, rows[1:]))
    import hashlib

    assert {tuple(r) for r in splitting.rejoined(splitting.split_oversized(df)).collect()} == {(c, hashlib.md5(t.encode()).hexdigest(), True) for c, t in (("b", "y" * 9000), ("d", "wort und " * 900))}
    assert splitting.split_oversized(df.limit(0)).collect() == []


# --- 6: fusion -----------------------------------------------------------------------------------------------------

RETRIEVED = "query_id string, chunk_id string, dense_rank int, sparse_rank int, rerank_score double, fused_score double, rank long, slice int"


def test_fusion_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for q in range(6):
        for c in range(30 if q else 400):
            rows.append((f"q{q}", f"c{c:03}", *(rng.choice([None, rng.randint(1, 9)]) for _ in range(2)), *(rng.choice([None, float("nan"), float(rng.randint(0, 9)) * 10**q]) for _ in range(2)), 1, 1))
    rows += rows[:20] + [(None, "x", 1, 1, 1.0, 1.0, 1, 1), ("q9", "only", None, None, None, None, 1, 1)]
    got = {(r.query_id, r.chunk_id): (r.rrf, r.place) for r in fusion.fuse(spark.createDataFrame(rows, RETRIEVED)).collect()}
    clean = {(r[0], r[1]): [v if v is not None and v == v else None for v in r[2:6]] for r in rows if r[0]}
    want = {}
    for q in {k[0] for k in clean}:
        mine = {k: v for k, v in clean.items() if k[0] == q}
        score = {k: 0.0 for k in mine}
        for j in range(4):
            for k, v in mine.items():
                if v[j] is not None:
                    better = sum(1 for w in mine.values() if w[j] is not None and (w[j] < v[j] if j < 2 else w[j] > v[j]))
                    score[k] += 1 / (fusion.K + 1 + better)
        for place, k in enumerate(sorted(mine, key=lambda k: (-round(score[k], 12), k[1])), 1):
            want[k] = (pytest.approx(score[k], abs=1e-11), place)
    assert got == want
    assert fusion.winners(spark.createDataFrame([], RETRIEVED)).collect() == []


def test_a_winner_must_lead_alone(spark):
    rows = [("q", "a", 1, 1, 9.0, 9.0, 0, 0), ("q", "b", 2, 2, 8.0, 8.0, 0, 0), ("r", "a", 1, 1, 9.0, 9.0, 0, 0), ("r", "b", 2, 1, 8.0, 8.0, 0, 0), ("s", "a", 1, 1, None, 9.0, 0, 0), ("t", "a", 1, 1, 9.0, 9.0, 0, 0), ("t", "b", None, None, None, None, 0, 0)]
    assert {tuple(r) for r in fusion.winners(spark.createDataFrame(rows, RETRIEVED)).collect()} == {("q", "a"), ("t", "a")}


# --- 4: look-alikes ------------------------------------------------------------------------------------------------


def test_look_alikes(spark):
    rows = [
        ("full", "the Ｌｉｃｅｎｓｅｅ must", None), ("liga", "certiﬁed", None), ("acc", "Ko\u030brmezva\u0301r", None), ("inv", "be​fore", None), ("nbsp", "a b", None), ("cyr", "thаt раѕѕеѕ", None),
        ("script", "followinɡ", None), ("roman", "Article Ⅱ", None), ("plain", "Kőrmezvár “q” – § é", None), ("other", "Общество σύμβαση 契約書", None), ("null", None, [None]),
        ("term", "plain", ["x", "Ｃｏｌｄ Store"]), ("term", "plain", ["x", "Ｃｏｌｄ Store"]), (None, "Ａ", ["Ａ"]), ("empty", "", []),
    ]
    df = chunk_rows(spark, rows)
    got = {tuple(r) for r in lookalikes.found(df).collect()}
    assert got == {(x, "text") for x in ("full", "liga", "acc", "inv", "nbsp", "cyr", "script", "roman")} | {("term", "defines_terms")}
    forms = {r.chunk_id: r.form for r in lookalikes.unified(df).collect()}
    assert forms["full"] == "the Licensee must" and forms["cyr"] == "that passes" and forms["nbsp"] == "a b" and forms["term"] == "Cold Store"
    assert forms["acc"] == unicodedata.normalize("NFC", "Kőrmezvár") and forms["script"] == "following" and forms["roman"] == "Article II"
    assert lookalikes.found(df.limit(0)).collect() == []


def test_the_written_form_is_canonical(spark):
    rows = [("a", "the Straße is long", None), ("b", "the Strａße is long", None), ("c", "ՕՕΡՏ and Ꭺct", None), ("d", "ｶﾞ 5 \u212a and № 7", None), ("e", "x² is ½ of ª … ™", None)]
    df = chunk_rows(spark, rows + [(f"s{k}", "Strasse", None) for k in range(9)])
    assert {(r.chunk_id, r.token, r.canonical) for r in lookalikes.rewrites(df).collect()} == {("b", "Strａße", "Straße"), ("c", "ՕՕΡՏ", "OOPS"), ("c", "Ꭺct", "Act"), ("d", "ｶﾞ", "ガ"), ("d", "\u212a", "K"), ("d", "№", "No")}
    assert len(lookalikes.LOOKALIKE) == len(lookalikes.PLAIN) == len(set(lookalikes.LOOKALIKE))


def test_fold_is_stable():
    for s in ("ＡΒс", "Общество", "a­́", "ﬁ x", "Ａ̈"):
        assert lookalikes.fold(lookalikes.fold(s)) == lookalikes.fold(s)


# --- 3: near-duplicates ---------------------------------------------------------------------------------------------


def varied(rng, words):
    out = list(words)
    for _ in range(rng.randint(0, 4)):
        k = rng.randrange(len(out))
        out[k : k + rng.randint(0, 1)] = [f"new{rng.randint(0, 999)}"] * rng.randint(0, 2)
    return out


def near_rows():
    rng = random.Random(11)
    rows = []
    for g in range(25):
        words = [rng.choice(["shall", "the", "party"]) + str(rng.randint(0, 300)) for _ in range(rng.randint(28, 120))]
        rows += [(f"g{g}_{k}", " ".join(varied(rng, words)), None) for k in range(rng.choice([1, 1, 2, 3, 40 if g == 3 else 4]))]
    rows += [("copy1", rows[0][1].upper() + "!", None), ("copy2", rows[0][1], None), ("copy3", rows[0][1], None), ("copy2", rows[0][1], None), ("none", None, None), ("short", "too short", None), (None, rows[0][1], None)]
    return rows


def near_truth(rows):
    sets = {}
    for i, t, _ in rows:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        if i and len(w) >= 30:
            sets[i] = set(zip(w, w[1:], w[2:]))
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}


def test_near_duplicates_against_brute_force(spark):
    rows = near_rows()
    df = chunk_rows(spark, rows)
    truth = near_truth(rows)
    got = [tuple(r) for r in neardup.pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == truth and len(truth) > 50
    groups = {r.chunk_id: r.group_id for r in neardup.groups(df).collect()}
    assert all(groups[a] == groups[b] for a, b in truth) and set(groups) == {x for p in truth for x in p}
    assert neardup.pairs(df.limit(0)).collect() == []


def test_large_groups_of_copies_keep_their_links(spark):
    rows = [(f"c{k:03}", " ".join(f"w{j}" for j in range(60)), None) for k in range(80)] + [("other", " ".join(f"w{j}" for j in range(58)), None)]
    got = {tuple(r) for r in neardup.pairs(chunk_rows(spark, rows)).collect()}
    assert got == {("c000", f"c{k:03}") for k in range(1, 80)} | {("c000", "other")}


def test_slices_of_a_large_block(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SLICE", 8)
    rows = near_rows()
    assert {tuple(r) for r in neardup.pairs(chunk_rows(spark, rows)).collect()} == near_truth(rows)


@pytest.mark.parametrize("box", [0, 8])
def test_a_tree_is_used_where_it_spares_work_only(spark, monkeypatch, box):
    monkeypatch.setattr(neardup, "SLICE", 8)
    monkeypatch.setattr(neardup, "BOX", box)
    rows = near_rows()
    assert {tuple(r) for r in neardup.pairs(chunk_rows(spark, rows)).collect()} == near_truth(rows)


def test_hot_blocks_are_cut_into_slices(spark, monkeypatch):
    for name, value in (("BUCKET", 20_000), ("PART", 100), ("HOT", 40)):
        monkeypatch.setattr(neardup, name, value)
    rows = near_rows() + [(f"h{k:03}", " ".join([f"w{j}" for j in range(40)] + [f"x{k}y{j}" for j in range(k % 12)]), None) for k in range(120)]
    got = {tuple(r) for r in neardup.pairs(chunk_rows(spark, rows)).collect()}
    assert got == near_truth(rows) and len(got) > 5000


def test_texts_with_one_number_stay_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(neardup, "number", lambda text: F.pmod(F.xxhash64(text), F.lit(5)))
    rows = near_rows()
    assert {tuple(r) for r in neardup.pairs(chunk_rows(spark, rows)).collect()} == near_truth(rows)


def test_copies_have_a_representative(spark):
    text = " ".join(f"w{j}" for j in range(40))
    df = chunk_rows(spark, [("b", text, None), ("a", text, None), ("a", text, None), ("c", text + " more", None), ("s", "short", None), ("t", "short", None), (None, text, None), ("n", None, None)])
    assert sorted(tuple(r) for r in neardup.copies_of(df).collect()) == [("a", "a", 2), ("b", "a", 2)]
    assert neardup.copies_of(df.limit(0)).collect() == []


def test_no_link_is_missed_at_the_least_share(spark):
    rows, want = [], set()
    for k in range(600):  # 30 of 50 runs are shared: exactly 0.60
        head, a, b = ([f"{x}{k}q{j}" for j in range(n)] for x, n in (("h", 32), ("a", 10), ("b", 10)))
        rows += [(f"x{k:03}", " ".join(head + a), None), (f"y{k:03}", " ".join(head + b), None)]
        want.add((f"x{k:03}", f"y{k:03}"))
    assert {tuple(r) for r in neardup.pairs(chunk_rows(spark, rows)).collect()} == want


def stock_rows():
    """Texts made from a stock of sentences, so that every run is in many of them, some of them in varied copies."""
    rng = random.Random(5)
    stock = [" ".join(f"v{rng.randint(0, 60)}" for _ in range(8)) for _ in range(60)]
    texts = [[w for x in rng.sample(stock, rng.randint(5, 12)) for w in x.split()] for _ in range(250)]
    return [(f"s{k:03}_{j}", " ".join(varied(rng, words) if j else words), None) for k, words in enumerate(texts) for j in range(2 if k % 5 == 0 else 1)]


def test_the_signatures_of_a_text_do_not_grow_with_the_buckets(spark, tmp_path):
    from pyspark.sql import functions as F

    texts = neardup.base(chunk_rows(spark, stock_rows()))
    frequencies = neardup._frequencies(texts, 1)
    size = {}
    for buckets in (1, 4096):
        store = neardup.Store(str(tmp_path / str(buckets)))
        (tmp_path / str(buckets)).mkdir()
        packed = neardup.signatures(texts.select("key", "text"), buckets, 0.6, frequencies, neardup.Slices(frequencies, 1, buckets, neardup.HOT), store)
        size[buckets] = sum(sum(len(v) for v in r.asDict().values() if isinstance(v, (bytes, bytearray)) and len(v) % 8 == 0) for r in packed.collect())
        assert len({r.bucket for r in packed.select("bucket").distinct().collect()}) > buckets // 100
    assert size[4096] == size[1]


def test_large_blocks_are_searched_by_two_runs(spark, monkeypatch):
    rows = stock_rows()
    truth = near_truth(rows)
    assert {tuple(r) for r in neardup.pairs(chunk_rows(spark, rows)).collect()} == truth and len(truth) > 20
    for name, value in (("SPLIT", 4), ("WORTH", 0), ("TRIED", 300), ("BUCKET", 20_000)):
        monkeypatch.setattr(neardup, name, value)
    assert {tuple(r) for r in neardup.pairs(chunk_rows(spark, rows)).collect()} == truth


def test_a_bucket_by_two_runs_finds_every_link_with_less_work(tmp_path, monkeypatch):
    import numpy as np

    rng = random.Random(6)
    texts = [[w for i in rng.sample(range(1000), rng.randint(35, 45)) for w in (f"a{i}", f"b{i}", f"c{i}")] for _ in range(600)]
    rows = [(f"s{k:03}_{j}", " ".join(varied(rng, words) if j else words), None) for k, words in enumerate(texts) for j in range(2 if k % 5 == 0 else 1)]
    rows += [("one_a", " ".join(["again"] * 30), None), ("one_b", " ".join(["again"] * 31), None)]
    sets = [neardup.runs(t) for _, t, _ in rows]
    none = np.zeros(0, np.uint64)
    rare = [neardup.prefix(r, none, none.astype(np.int64), 0.6, neardup.LATER) for r in sets]
    each = np.array([len(x) for x in rare])
    head = np.zeros(len(sets), neardup._HEAD)
    head["key"], head["total"], head["start"], head["held"] = np.arange(len(sets)), [len(r) for r in sets], np.cumsum(each) - each, [neardup.marks(r) for r in sets]
    store = neardup.Store(str(tmp_path))
    r, text = np.concatenate(rare), np.repeat(np.arange(len(sets)), each)
    name = store.write(head, r >> np.uint64(32))
    place = np.arange(len(r)) - head["start"][text]
    mine = place < neardup.reach(head["total"], 0.6)[text]
    entry = np.zeros(mine.sum(), neardup._ENTRY)
    entry["run"], entry["text"], entry["place"] = r[mine] >> np.uint64(32), text[mine], place[mine]
    as_sets = [set(r.tolist()) for r in sets]
    truth = {(i, j) for i, j in combinations(range(len(sets)), 2) if len(as_sets[i] & as_sets[j]) >= 0.6 * len(as_sets[i] | as_sets[j])}
    looked, listed = [], neardup._listed
    monkeypatch.setattr(neardup, "_listed", lambda begin, mates, *rest: looked.append(int(mates[begin].sum())) or listed(begin, mates, *rest))
    work = []
    for split, worth, slice_ in ((1 << 30, 4, 4096), (4, 0, 4096), (4, 0, 3)):
        for what, value in (("SPLIT", split), ("WORTH", worth), ("SLICE", slice_)):
            monkeypatch.setattr(neardup, what, value)
        looked.clear()
        got = set(zip(*(x.tolist() for x in neardup._in_bucket([name], [entry.tobytes()], store, 0.6))))
        assert got >= truth and len(truth) > 20
        work.append(sum(looked))
    assert work[1] < 0.5 * work[0]


def test_a_store_on_another_file_system_is_read_as_well(spark, tmp_path, monkeypatch):
    import numpy as np

    class Elsewhere:
        @staticmethod
        def from_uri(uri):
            return neardup.fs.SubTreeFileSystem("/", neardup.fs.LocalFileSystem()), str(uri)

    monkeypatch.setattr(neardup.fs, "FileSystem", Elsewhere)
    store, head = neardup.Store(str(tmp_path)), np.zeros(3, neardup._HEAD)
    head["key"] = [5, 6, 7]
    name = store.write(head, np.arange(4, dtype=np.uint64))
    for _ in range(2):
        heads, rarest = store.read(name)
        assert heads["key"].tolist() == [5, 6, 7] and rarest.tolist() == [0, 1, 2, 3]


def test_shared_parts_are_the_same_however_words_are_numbered(monkeypatch):
    texts = [t for _, t, _ in near_rows() if t]
    for most, kept in ((1 << 21, 2_000_000), (900, 300), (1, 300)):
        monkeypatch.setattr(neardup._Exact, "MOST", most)
        monkeypatch.setattr(neardup._Exact, "KEPT", kept)
        exact = neardup._Exact()
        for a, b in [(i, (i * 7 + 1) % len(texts)) for i in range(len(texts))]:
            x, y = (set(zip(w, w[1:], w[2:])) if len(w) >= neardup.WORDS else set() for w in (re.findall("[a-z0-9]+", texts[k].lower()) for k in (a, b)))
            common, either = exact.shared(a, b, texts[a], texts[b])
            assert (common, either) == (len(x & y), len(x | y)) or not (x and y)


def test_the_tree_bounds_from_above():
    import numpy as np

    rng = np.random.default_rng(4)
    points = rng.integers(0, 4, (500, neardup.GROUPS + 1)).astype(np.uint8)
    points[:, -1] = 0
    totals = points.sum(axis=1).astype(np.int64)
    q, p = neardup.CountTree(points, totals).matches(points, totals, 0.6)
    least = np.minimum(points[:, None, :], points[None]).sum(axis=2, dtype=np.int64)
    assert set(zip(q.tolist(), p.tolist())) == set(map(tuple, np.argwhere(least >= neardup.needed(totals[:, None], totals[None, :], 0.6)).tolist()))


# --- 2: scanned pages -----------------------------------------------------------------------------------------------

PROSE = "The Supplier shall deliver the goods within the agreed period and the Customer shall accept the goods without delay unless the inspection shows that the materials are defective and the parties agree otherwise in writing before the goods are returned to the warehouse of the Supplier at the expense of the Customer."


def page(words, furniture=None, width=60):
    lines, line = [], ""
    for w in words.split():
        if "|" in w:
            lines.append(f"{line} {w[: w.index('|')]}")
            line = w[w.index("|") + 1 :]
            continue
        if line and len(line) + 1 + len(w) > width:
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    lines.append(line)
    for at, text in (furniture or {}).items():
        lines.insert(at, text)
    return "\n".join(lines)


def scanned_rows():
    rows = [(f"clean{k}", PROSE, None) for k in range(40)]
    rows += [(f"head{k}", page(f"Part{'abcdefgh'[k]} " + PROSE, {1 + k % 4: "SUPPLY AGREEMENT" + ("          12" if k == 7 else "")}), None) for k in range(8)]
    rows += [("num", page(PROSE, {2: "- 14 -"}), None), ("roman", page(PROSE, {3: "xii"}), None), ("wrapped", page(PROSE), None)]
    rows += [("chars", PROSE.replace("goods", "g0ods", 1), None), ("letters", PROSE.replace("inspection", "inspecfion"), None), ("digits", "It ends after 4S days. " + PROSE, None)]
    rows += [("cut", page(PROSE.replace("inspection", "inspec-|tion")), None), ("keeps", "The non-\nexclusive right is given.\n" + PROSE, None), ("comp", "The non-exclusive right and the non-exclusive licence.", None), ("null", None, None), ("empty", "", None), (None, "- 3 -\nx", None)]
    return rows


def test_scanning_noise(spark):
    sections = spark.createDataFrame([("PAYMENT TERMS",)], "title string")
    got = {tuple(r) for r in scanned.found(chunk_rows(spark, scanned_rows()), sections).collect()}
    assert {(f"head{k}", "header") for k in range(8)} <= got and ("head7", "page_no") in got
    assert {("num", "page_no"), ("roman", "page_no"), ("chars", "chars"), ("letters", "chars"), ("digits", "chars"), ("cut", "hyphen")} <= got
    assert not [x for x in got if x[0] in ("wrapped", "keeps", "comp", "empty", None) or (x[0] or "").startswith("clean")]
    assert len(got) == 15
    none = spark.createDataFrame([], CHUNKS)
    assert scanned.found(none, sections).collect() == []


def test_company_header_between_whole_sentences():
    heads, _, _, _ = scanned.clues("The goods are delivered to the warehouse of the Customer in time.\nOrion Systems Inc.\nThe Customer pays the price of the goods within thirty days.")
    assert [(h[0], h[2]) for h in heads] == [("orion systems inc.", 0)]
    heads, _, _, _ = scanned.clues("The goods are delivered to the warehouse of the\nOrion Systems Inc.\nthe Customer pays the price of the goods within thirty days.")
    assert [(h[0], h[2]) for h in heads] == [("orion systems inc.", 1)]


def test_headers_repeat_fuzzily(spark):
    names = ["Orion Systems", "Vertex Foods", "Kappa Energy", "Nadir Media", "Mutua1 Works", "Zeta Freight", "Astra Labs", "Borealis Tools"]
    rows = [(f"clean{k}", page(f"Part{'abcdefgh'[k]} " + PROSE), None) for k in range(8)]
    rows += [(f"h{k}", page(f"Item{'abcdefgh'[k]} " + PROSE, {1 + k % 3: f"{n} / Non Disclosure Deed"}, width=48 + 3 * k), None) for k, n in enumerate(names)]
    wide = "Schedule " + " ".join(f"{w} and" for w in ("Supplies", "Services", "Premises", "Payments", "Notices", "Licences", "Records", "Insurance", "Carriage")) + " Deliveries"
    rows += [(f"wide{k}", page(f"Term{'abcdefgh'[k]} " + PROSE, {1: wide}, width=190 + 10 * k), None) for k in range(2)]
    rows += [(f"wide{k}", page(f"Term{'abcdefgh'[k]} and more of it " + PROSE, {1: wide}, width=190 + 10 * k), None) for k in range(2, 5)]
    assert len(wide) > 120
    got = {tuple(r) for r in scanned.found(chunk_rows(spark, rows), spark.createDataFrame([], "title string")).collect()}
    assert {c for c, noise in got if noise == "header"} == {f"h{k}" for k in range(8)} | {f"wide{k}" for k in range(5)}


def test_words_of_any_length_count(spark):
    word = "internationalisation" * 3
    bad = word.replace("o", "0", 1)
    rows = [(f"c{k}", f"The {word} is agreed.", None) for k in range(30)] + [("bad", f"The {bad} is agreed.", None), ("cut", f"The {word[:31]}-\n{word[31:]} is agreed.", None)]
    got = {tuple(r) for r in scanned.found(chunk_rows(spark, rows), spark.createDataFrame([], "title string")).collect()}
    assert got == {("bad", "chars"), ("cut", "hyphen")}


def test_letters_before_counted_words(spark):
    rows = [(f"c{k}", f"It ends after {k + 10} fortnights and the parties agree.", None) for k in range(30)] + [("bad", "It ends after lS fortnights and the parties agree.", None), ("fine", "As to IS parties agree.", None)]
    df = chunk_rows(spark, rows)
    none = spark.createDataFrame([], "title string")
    assert {tuple(r) for r in scanned.found(df, none).collect()} == {("bad", "chars")}
    assert {r.chunk_id: r.repaired for r in scanned.repaired_texts(df, none).collect()} == {"bad": "It ends after 15 fortnights and the parties agree."}


def test_bars_at_the_ends_of_words(spark):
    sections = spark.createDataFrame([("PAYMENT TERMS",)], "title string")
    sound = "The license shall hold and the parties will keep the goods."
    bad = {"first": sound.replace("license", "|icense"), "last": sound.replace("shall", "shal|"), "two": sound.replace("will", "wi||"), "mark": sound.replace("goods.", "g0ods!")}
    df = chunk_rows(spark, [(f"c{k}", sound, None) for k in range(60)] + [(k, t, None) for k, t in bad.items()] + [("real", "The goods! And | the license.", None)])
    assert {tuple(r) for r in scanned.found(df, sections).collect()} == {(k, "chars") for k in bad}
    got = {r.chunk_id: r.repaired for r in scanned.repaired_texts(df, sections).collect()}
    assert got == {k: sound for k in bad if k != "mark"} | {"mark": sound[:-1] + "!"}


def test_repair_gives_the_paragraph_back(spark):
    sections = spark.createDataFrame([("PAYMENT TERMS",)], "title string")
    got = {r.chunk_id: r.repaired for r in scanned.repaired_texts(chunk_rows(spark, scanned_rows()), sections).collect()}
    for c in ("num", "roman", "chars", "letters", "cut"):
        assert got[c] == PROSE, (c, got[c])
    assert got["head2"].endswith(PROSE) and "AGREEMENT" not in got["head2"]
    assert got["digits"].startswith("It ends after 45 days.")


def test_planted_noise_is_taken_out_again(spark):
    """Sound clauses of the test data, wrapped and given a header, a page number and a cut word each, must come back as they were."""
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    chunks, sections = spark.read.parquet(f"{folder}/chunks.parquet"), spark.read.parquet(f"{folder}/sections.parquet")
    noisy = scanned.found(chunks, sections).select("chunk_id").distinct()
    odd = lookalikes.found(chunks).select("chunk_id").distinct()
    sound = chunks.where("text is not null and length(text) between 400 and 1500 and not text rlike '[\\n\\r]' and not text rlike '  '").join(noisy.union(odd), "chunk_id", "left_anti")
    sound = [r.text for r in sound.select("text").distinct().orderBy("text").limit(80).collect()]
    assert len(sound) == 80
    rng, planted = random.Random(8), {}
    for k, text in enumerate(sound):
        width, lines, cut = rng.randint(58, 74), [""], False
        for w in text.split(" "):
            room = width - len(lines[-1]) - 1
            if lines[-1] and len(w) > room:
                if not cut and len(lines) > 4 and room > 5 and re.fullmatch("[a-z]{9,}", w):
                    lines[-1] += f" {w[:5]}-"
                    w, cut = w[5:], True
                lines.append(w)
            else:
                lines[-1] = f"{lines[-1]} {w}".strip()
        lines[2:2] = [f"Lumenfield Freight Bill No. {k}", f"- {rng.randint(1, 99)} -"]
        planted[f"planted{k}"] = "\n".join(lines)
    both = chunks.select("chunk_id", "text", "section_title").unionByName(spark.createDataFrame([(c, t, None) for c, t in planted.items()], "chunk_id string, text string, section_title string"))
    back = {r.chunk_id: r.repaired for r in scanned.repaired_texts(both, sections).where("chunk_id like 'planted%'").collect()}
    right = sum(back.get(f"planted{k}") == text for k, text in enumerate(sound))
    wrong = [(planted[f"planted{k}"], back.get(f"planted{k}"), text) for k, text in enumerate(sound) if back.get(f"planted{k}") != text]
    assert right >= 0.9 * len(sound), (right, wrong[0])


# --- 9: language ----------------------------------------------------------------------------------------------------

SAMPLES = {
    "en": "the party shall deliver the goods to the customer within thirty days and bear all costs of the carriage",
    "de": "die Partei liefert die Ware innerhalb von dreißig Tagen an den Kunden und trägt alle Kosten der Beförderung",
    "fr": "la partie livre la marchandise au client dans un délai de trente jours et supporte tous les frais du transport",
}


def filed(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, confidence double")


def language_rows():
    rng = random.Random(7)
    rows = []
    for i in range(240):
        code = ("en", "de", "fr")[i % 3]
        words = SAMPLES[code].split()
        text = "\n\n".join(" ".join(rng.sample(words, 14)) for _ in range(3))
        label = {0: "fr" if code != "fr" else "en", 1: None, 2: "und"}.get(i % 30 // 3, {"en": "English", "de": "de-AT", "fr": "fra"}[code] if i % 4 == 0 else code)
        rows.append((i, text, label, 0.5))
    mixed = "\n\n".join([SAMPLES["en"], SAMPLES["en"], SAMPLES["de"]])
    return rows + [(1000, mixed, "en", 0.5), (1001, None, "en", 0.5), (1002, "", None, 0.5), (1003, "21.7  5,045", None, 0.5)]


def test_languages(spark):
    langs = spark.createDataFrame([("en", "English"), ("de", "German"), ("fr", "French"), ("it", "Italian")], "lang string, name string")
    rows = language_rows()
    df = filed(spark, rows)
    got = {tuple(r) for r in language.wrong_labels(df, langs).collect()}
    want = {(i, 0, ("en", "de", "fr")[i % 3]) for i in range(240) if i % 30 // 3 in (0, 1, 2)} | {(1000, 3, "de")}
    assert got == want
    assert language.segments(df.limit(0), langs).collect() == []
    for r in language.segments(df, langs).where("para_no = 0").collect():
        assert 0 < r.confidence <= 1


def test_texts_in_no_language_of_the_table(spark):
    langs = spark.createDataFrame([("en", "English"), ("de", "German"), ("fr", "French")], "lang string, name string")
    finnish = "tämä sopimus on laadittu kahtena samansisältöisenä kappaleena yksi kummallekin osapuolelle"
    df = filed(spark, language_rows() + [(2000, finnish, "fi", 0.5), (2001, "\n\n".join([SAMPLES["en"], finnish]), "en", 0.5)])
    got = {(r.doc_id, r.para_no): (r.lang, r.confidence) for r in language.segments(df, langs).where("doc_id >= 2000").collect()}
    assert got[2000, 0][0] == got[2000, 1][0] == got[2001, 2][0] == "und" and got[2001, 0][0] == "en" and 0 < got[2000, 0][1] <= 1
    assert not [r for r in language.wrong_labels(df, langs).collect() if r.doc_id >= 2000]


def test_long_words_count_whole():
    models = language.Models({"a": language.ContextTree(Counter({"ab": 5})), "b": language.ContextTree(Counter({"xy": 5}))})
    head = "ab" * 20
    bits, letters = models.measured([head + "xy" * 200, head, "ab cd"])
    assert bits[0].argmin() == 1 and bits[1].argmin() == 0 and letters.tolist() == [440, 40, 4]


def test_code_lengths_are_a_distribution():
    tree = language.ContextTree(Counter("abc abd abd xyz".split()))
    assert tree.bits("abd") < tree.bits("abc") < tree.bits("qqq")
    one = sum(2 ** -language.ContextTree({"a": 1}).bits(w) for w in ["a", *(chr(c) for c in range(98, 123))])
    assert one < 1.0
