"""Vector packing, fill-in-the-middle and runs of words, against brute force and round trips."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from facetmill.llm import fim, periodic, queries, vector_packing, word_ids

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# ---- 11 vector packing


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_ids.default_path())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r\x0b\x0c\x1c\x85\xa0'sdtlve0123²½aAéÀßΣσİı́—“…€|%$<>&!."), st.characters(min_codepoint=0x80, max_codepoint=0x24F), st.characters(codec="utf-8")), max_size=60))
def test_ids_are_those_of_the_library(text):
    words = word_ids.load(word_ids.default_path())
    latin = "".join(c for c in text if not word_ids._OTHER.match(c))
    for t in (text, latin, latin.upper(), f"{text} <|endoftext|> {text}<|startoftext|>"):
        assert np.frombuffer(words.ids(t), "<u4").tolist() == words.library.encode(t, add_special_tokens=False).ids


def test_words_are_forgotten(library):
    words = word_ids.WordIds(word_ids.default_path(), limit=3)
    text = "one two three four five one two " + "x" * 100
    assert np.frombuffer(words.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids and len(words.parts) <= 3


def test_every_vocabulary_string(library):
    """Merging by rank gives the library's ids for every string of the vocabulary, alone, in upper case and beside others."""
    words = word_ids.load(word_ids.default_path())
    for token in library.get_vocab():
        text = token.removesuffix("</w>")
        if text.isascii() and text not in words.added:
            for t in (text, f"{text.upper()}{text}", f"x{text}'s7"):
                assert np.frombuffer(words.ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def check_sequences(found, cfg):
    """No overlap, no gap, no limit exceeded; sequences short of the limit have lengths that are powers of two."""
    by = collections.defaultdict(list)
    for r in found:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert len(pieces) <= cfg.segments and (at == cfg.tokens or at < cfg.tokens and at & (at - 1) == 0)


@pytest.mark.parametrize("cfg", [vector_packing.VectorConfig(), vector_packing.VectorConfig(tokens=64, segments=4, losses=64, bucket_tokens=3000)])
def test_packing(spark, awkward, empty, sample, library, cfg):
    for docs in (awkward, sample.select("doc_id", "text")):
        found = rows(vector_packing.pack_documents(docs, cfg))
        check_sequences(found, cfg)
        # Rows of one doc_id may differ in text: pieces are matched to the ids they claim to hold.
        wanted = collections.Counter()
        for d in docs.select("doc_id", "text").collect():
            ids = np.array([*library.encode(d["text"] or "", add_special_tokens=False).ids, 2], "<u4")
            wanted[d["doc_id"], len(ids)] += len(ids)
            for r in found:
                if (r["doc_id"], r["doc_tokens"]) == (d["doc_id"], len(ids)):
                    assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        got = collections.Counter()
        spans = collections.defaultdict(list)
        for r in found:
            got[r["doc_id"], r["doc_tokens"]] += r["length"]
            spans[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"]))
        assert got == wanted
        for key, parts in spans.items():
            cover = collections.Counter(i for a, n in parts for i in range(a, a + n))
            assert set(cover) == set(range(key[1])) and len(set(cover.values())) == 1
    assert rows(vector_packing.pack_documents(empty, cfg)) == []


def test_little_padding_and_reruns(spark):
    first = rows(queries.op11_vector_packing(spark, SF))
    total = sum(r["length"] for r in first)
    assert len({r["sequence_id"] for r in first}) <= total // 4096 + 12
    key = lambda r: (r["doc_id"], r["start"])
    again = rows(queries.op11_vector_packing(spark, SF))
    assert sorted(first, key=key) == sorted(again, key=key)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(0, 40), st.integers(0, 40)), max_size=25), st.integers(1, 30), st.integers(1, 5), st.integers(1, 30), st.booleans(), st.booleans())
def test_limits_hold(items, tokens, segments, losses, cut, power):
    cfg = vector_packing.VectorConfig(tokens=tokens, segments=segments, losses=losses, cut=cut, power_of_two=power)
    sizes, bounds = [n for n, _, _ in items], [[min(a, n), min(a + b, n)] for n, a, b in items]
    cover = collections.Counter()
    for s in vector_packing.place(sizes, bounds, cfg):
        size = sum(n for *_, n in s)
        bears = sum(vector_packing.loss_below(bounds[i], a + n) - vector_packing.loss_below(bounds[i], a) for i, a, n in s)
        assert 0 < size <= tokens and len(s) <= segments and bears <= losses and (not power or size == tokens or size & (size - 1) == 0)
        cover.update((i, x) for i, a, n in s for x in range(a, a + n))
        if not cut and not power:
            assert all(n == sizes[i] or sizes[i] > tokens or bounds[i][1] - bounds[i][0] > losses for i, a, n in s)
    assert cover == collections.Counter((i, x) for i, n in enumerate(sizes) for x in range(n))


def test_dot_product_chooses():
    """Of two examples that fit, the one whose loss suits the room left goes in first."""
    cfg = vector_packing.VectorConfig(tokens=10, segments=3, losses=4, cut=False, power_of_two=False)
    sizes, bounds = [6, 4, 4, 6], [[0, 4], [0, 4], [0, 0], [0, 0]]
    found = vector_packing.place(sizes, bounds, cfg)
    assert len(found) == 2 and all(sum(n for *_, n in s) == 10 for s in found)


def test_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "what is this"), (1, 1, "assistant", "a long answer " * 60), (2, 0, None, None), (None, 1, "assistant", "yes")], "conv_id long, turn long, role string, text string")
    cfg = vector_packing.VectorConfig(tokens=64, segments=8, losses=16)
    found = rows(vector_packing.pack_turns(turns, cfg))
    check_sequences(found, cfg)
    loss = collections.Counter()
    for r in found:
        loss[r["sequence_id"]] += r["length"] if r["turn"] == 1 else 0
    assert max(loss.values()) <= 16 and sum(loss.values()) == 181 + 2


# ---- 12 fill-in-the-middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def middle_by_force(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    a, z = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "bc ", " ", "\n\t", "é", "𝒳 ", "<", "<S", ">", "<P>", "\x1c", "\xa0", "word " * 300]), max_size=12).map("".join), st.one_of(st.none(), st.integers(-5, 10**12)))
def test_middle_by_force(text, doc_id):
    found = fim.rearranged(text, doc_id)
    assert found == middle_by_force(doc_id, text)
    assert fim.restored(found[4], found[1]) == text


def test_middle_table(spark, awkward, empty):
    got = rows(fim.restore(fim.fill_in_middle(awkward)))
    want = [(r["doc_id"], *middle_by_force(r["doc_id"], r["text"]), r["text"] or "") for r in awkward.collect()]
    assert collections.Counter(tuple(r.values()) for r in got) == collections.Counter(want)
    assert rows(fim.restore(fim.fill_in_middle(empty))) == []
    assert fim.restore(spark.createDataFrame([("plain", None, 1)], "form string, output string, text int")).first()["text"] is None


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 3000), st.lists(st.tuples(st.floats(0, 1), st.sampled_from(["units", "chars"])), max_size=8))
def test_ropes_stay_whole_and_balanced(n, cuts):
    text = "".join(f" w{i}" if i % 3 else "\n x  y" for i in range(n))
    rope = fim.Rope.of(text)

    def check(node):
        if node is not None and node.text is None:
            assert abs(node.left.height - node.right.height) <= 1 and node.height == 1 + max(node.left.height, node.right.height)
            assert (node.units, node.chars) == (node.left.units + node.right.units, node.left.chars + node.right.chars)
            check(node.left)
            check(node.right)

    for share, by in cuts:
        if rope is None:
            break
        at = int(share * getattr(rope, by))
        a, b = fim.split(rope, at, by)
        parts = ["".join(x.leaves()) if x else "" for x in (a, b)]
        assert "".join(parts) == "".join(rope.leaves())
        if by == "chars":
            assert len(parts[0]) == at
        check(a)
        check(b)
        rope = fim.concat(b, a)
        check(rope)


def test_long_text_keeps_a_low_tree():
    text = "word and more " * 100_000
    assert fim.Rope.of(text).height <= 12
    n, form, p, m, out = fim.rearranged(text, 3)
    assert (n, fim.restored(out, form)) == (300_001, text)


# ---- 13 runs of words


def runs_by_force(words, least_words=24, least_periods=3):
    n, found = len(words), {}
    for q in range(1, n // least_periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least_words, least_periods * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@st.composite
def word_lists(draw):
    n, kinds = draw(st.integers(0, 150)), draw(st.integers(1, 6))
    words = [str(draw(st.integers(0, kinds))) for _ in range(n)]
    for _ in range(draw(st.integers(0, 3))):
        if n:
            a, p = draw(st.integers(0, n - 1)), draw(st.integers(1, 30))
            z = draw(st.integers(a, n))
            words = [words[a + (i - a) % p] if a <= i < z else words[i] for i in range(n)]
    return words


@settings(max_examples=150, deadline=None)
@given(st.lists(word_lists(), max_size=4), st.sampled_from([(24, 3), (7, 3), (1, 2), (4, 2)]))
def test_runs_by_force(documents, least):
    assert periodic.find_runs(documents, periodic.RunConfig(*least)) == [runs_by_force(d, *least) for d in documents]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80))
def test_extensions_by_force(symbols):
    x = np.array([*symbols, 9])
    lce = periodic.Extensions(x)
    i, j = (a.ravel() for a in np.meshgrid(range(len(x)), range(len(x))))
    i, j = i[i != j], j[i != j]

    def force(a, b):
        n = 0
        while max(a, b) + n < len(x) and x[a + n] == x[b + n]:
            n += 1
        return n

    assert lce(i, j).tolist() == [force(a, b) for a, b in zip(i, j)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=400), st.randoms())
def test_range_minimum(values, rng):
    least = periodic.RangeMin(np.array(values, np.int32))
    l = np.array([rng.randrange(len(values)) for _ in range(50)])
    r = np.array([rng.randrange(a, len(values)) for a in l])
    assert least(l, r).tolist() == [min(values[a : z + 1]) for a, z in zip(l, r)]


def runs_row(doc_id, text):
    """What the query says of a document, by the words of its contract."""
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_force(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_runs_query(spark, tmp_path, awkward, sample):
    rng = random.Random(3)
    more = [(1000 + i, " ".join(rng.choice("ab") for _ in range(rng.randrange(200))), None, None, None, 0, None, None) for i in range(60)]
    small = awkward.filter("coalesce(length(text), 0) < 50000")
    docs = small.unionByName(spark.createDataFrame(more, awkward.schema)).select("doc_id", "text").unionByName(sample.select("doc_id", "text").filter("length(text) < 6000"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r.values()) for r in rows(queries.op13_periodic_runs(spark, str(tmp_path)))]
    want = [runs_row(r["doc_id"], r["text"]) for r in docs.collect()]
    assert collections.Counter(got) == collections.Counter(want)
    assert sum(r[1] > 0 for r in got) > 30


def test_runs_awkward(spark, awkward, empty):
    assert rows(periodic.periodic_runs(empty)) == []
    assert [r["n_runs"] for r in rows(periodic.periodic_runs(awkward.filter("doc_id = 7 or text is null")))] == [0] * 3  # a period of 12,701 words, less than three times
    same = periodic.periodic_runs(spark.createDataFrame([(1, "a " * 100_000)], "doc_id long, text string")).first()
    assert (same["n_runs"], same["start"], same["length"], same["period"], same["text"]) == (1, 0, 100_000, 1, "a")


def test_rows_far_from_each_other_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(periodic, "HELD", 10)
    words = "x y z " * 20
    got = periodic.periodic_runs(spark.createDataFrame([(i, words) for i in range(5)], "doc_id long, text string").coalesce(1))
    assert {(r["n_runs"], r["start"], r["length"], r["period"], r["text"]) for r in got.collect()} == {(1, 0, 60, 3, "x y z")}
    assert got.select(F.count("*")).first()[0] == 5
