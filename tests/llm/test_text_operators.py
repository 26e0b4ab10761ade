import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from facetmill.llm import bpe, html_text, lm, media, mixing, near, packing, quality, suffixes, tokens, weak

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


# ---- 1 quality rules


def base(text):
    w = WORD.findall(text or "")
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_quality_base_counts(spark, awkward, sample, labels):
    for docs in (awkward, sample.limit(60)):
        texts = {r["doc_id"]: r["text"] for r in rows(docs) if r["doc_id"] is not None}
        for r in rows(quality.quality_report(docs, labels)):
            if r["doc_id"] in texts:
                assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(texts[r["doc_id"]])
                assert r["kept"] <= (not r["base_failed"])


def test_quality_empty_and_columns(awkward, empty, labels):
    assert rows(quality.quality_report(empty, labels)) == []
    kept = quality.quality_filter(awkward, labels)
    assert kept.columns == awkward.columns
    assert {1, 2, 3} <= {r["doc_id"] for r in rows(kept)}


def test_binomial_tail(spark):
    from pyspark.sql import functions as F

    got = spark.range(0, 40).select("id", quality.binomial_tail(F.col("id"), F.lit(40), 0.1).alias("p"))
    for r in rows(got):
        assert r["p"] == pytest.approx(min(1, sum(math.comb(40, i) * 0.1**i * 0.9 ** (40 - i) for i in range(r["id"] + 1))), rel=1e-9)
    deep = spark.range(1).select(quality.binomial_tail(F.lit(1000).cast("long"), F.lit(200_000).cast("long"), 0.02).alias("p")).first()["p"]
    assert 0 <= deep < 1e-200
    for k, n, p in ((900, 50_000, 0.02), (1000, 50_000, 0.02), (1100, 50_000, 0.02), (0, 30, 0.02), (21, 2000, 0.02)):
        log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)  # noqa: B023, E731
        got = spark.range(1).select(quality.binomial_tail(F.lit(k), F.lit(n), p).alias("p")).first()["p"]
        assert got == pytest.approx(math.fsum(math.exp(log(i)) for i in range(k + 1)), rel=1e-8)


def test_copies_are_one_trial(spark):
    """500 rows of one good text are one trial of the holdout: not enough for any cutoff."""
    text = "plain words that make up a good document of more than ten words in all"
    docs = spark.createDataFrame([(i, text, "en") for i in range(500)] + [(1000, "$$$ %%% " + text, "en")], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, 1, 0) for i in range(500)], "doc_id long, quality int, toxic int")
    assert all(r["kept"] for r in rows(quality.quality_report(docs, marks)))


def test_thresholds_stop_at_risk(spark):
    text = "plain words that make up a good document of more than ten words in all"
    docs = spark.createDataFrame([(i, f"{text} {i}" + (" $$" if i % 20 == 0 else ""), "en") for i in range(800)], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, 1, 0) for i in range(800)], "doc_id long, quality int, toxic int")
    assert all(r["kept"] for r in rows(quality.quality_report(docs, marks)))  # 5 % of good documents have symbols: no level may reject them
    bad = docs.unionByName(spark.createDataFrame([(1000 + i, "$$$ %%% " + text.replace(" ", " ### "), "en") for i in range(50)], docs.schema))
    out = rows(quality.quality_report(bad, marks))
    assert not any(r["kept"] for r in out if r["doc_id"] >= 1000)


# ---- 2 mixing


def test_mixing_targets_and_positions(spark, awkward, sample, empty):
    assert rows(mixing.mix_plan(empty)) == []
    for docs in (awkward, sample):
        plan = rows(mixing.mix_plan(docs))
        assert len(plan) == docs.count()
        sizes, target, taken = collections.Counter(), {}, collections.Counter()
        for r in plan:
            sizes[r["source"]] += r["size"]
            target[r["source"]] = r["target"]
            taken[r["source"]] += r["taken"]
            assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] == len(r["positions"]) * r["size"]
            assert all(0 <= p <= 1 for p in r["positions"])
        names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
        w = {s: 1 + i % 3 for i, s in enumerate(names)}
        full, want = set(), {}
        while True:
            left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
            share = {s: left * w[s] / sum(w[x] for x in names if x not in full) for s in names if s not in full}
            over = {s for s, v in share.items() if v > 3 * sizes[s] + 1e-9}
            if not over:
                want = share | {s: 3 * sizes[s] for s in full}
                break
            full |= over
        for s in names:
            assert target[s] == pytest.approx(want[s])
            assert abs(taken[s] - target[s]) <= max(r["size"] for r in plan if r["source"] == s)


def test_equal_rows_are_mixed_apart(spark):
    """Rows of one id and text whose other columns differ: each has its own copies, none is lost."""
    docs = spark.createDataFrame([(1, "a b c", "s", i) for i in range(4)] + [(1, "a b c", "t", 9), (2, None, None, 1), (None, "x y", "s", 5), (3, "p q r s t u", "t", 6)], "doc_id long, text string, source string, _h int")
    plan = collections.Counter()
    for r in rows(mixing.mix_plan(docs.drop("_h"))):
        plan[r["doc_id"], r["source"]] += r["copies"]
    mixed = rows(mixing.mix_documents(docs))
    assert collections.Counter((r["doc_id"], r["source"]) for r in mixed) == +plan
    again = rows(mixing.mix_documents(docs.repartition(3)))
    assert [tuple(r.values()) for r in mixed] == [tuple(r.values()) for r in again]


def test_mixed_documents_are_copies(spark, sample):
    want = collections.Counter({r["doc_id"]: r["copies"] for r in rows(mixing.mix_plan(sample))})
    mixed = mixing.mix_documents(sample)
    assert mixed.columns == sample.columns
    assert collections.Counter(r["doc_id"] for r in rows(mixed)) == +want


# ---- 3 html


def test_html():
    page = """<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><a href=x>Menu</a></nav><div class="ad">Buy now</div>
    <article><h1>Head &amp; line</h1><p>One <b>two</b>three<br>four<p>five&nbsp;&lt;x&gt;<div class='comments'>first!</div><form>name</form><!-- no --></article><footer>&copy; x</footer>"""
    assert html_text.main_text(page) == "Head & line One twothree four five\xa0<x>"
    assert html_text.main_text(None) == html_text.main_text("") == ""
    plain = "<body><div><a href=1>home</a> <a href=2>news</a></div>" + "".join(f"<p>{'long sentence of the text ' * 8}{i}</p>" for i in range(5)) + "<div><a href=3>terms of use and all that</a></div></body>"
    assert html_text.main_text(plain).startswith("long sentence") and html_text.main_text(plain).endswith("4")
    assert html_text.window_sums([1, 2, 3, 4], 2) == [3, 5, 7, 4]


def test_html_keeps_every_region():
    """Without article or main, a list of links or an advert inside the text divides it and costs nothing of it."""
    part = [f"{'long sentence of the text ' * n}{n}" for n in (4, 8, 1, 6)]
    links = "<ul>" + "".join(f"<li><a href={i}>related story {i}</a></li>" for i in range(4)) + "</ul>"
    advert = "<div class=ad>" + "<p>buy now</p>" * 3 + "</div>"
    page = f"<body><div><a href=1>home</a></div><p>{part[0]}</p>{links}<p>{part[1]}</p>{advert}<p>{part[2]}</p>{links}<p>{part[3]}</p></body>"
    assert html_text.main_text(page) == " ".join(part)


def test_names_inside_the_article():
    page = '<body><article><div class="widget-text"><p>Body one.</p></div><section id="side-effects">Two.</section><div class="ad">Buy</div><p class="search-results">Three.</p><div id=comments>first!</div></article></body>'
    assert html_text.main_text(page) == "Body one. Two. Three."


def test_every_page_by_another_parser(spark):
    """What a tree parser finds inside the article, block by block, on the whole table."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.blocks = 0, [""]

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            if tag not in ("b", "a", "i", "em", "strong", "span"):
                self.blocks.append("")

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            if tag not in ("b", "a", "i", "em", "strong", "span"):
                self.blocks.append("")

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1] += data

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in rows(pages):
        parser = Article()
        parser.feed(r["html"])
        parser.close()
        blocks = [re.sub(r"[\x20\x09-\x0D]+", " ", b).strip(" ") for b in parser.blocks]
        want[r["page_id"]] = (r["url"], " ".join(b for b in blocks if b))
    got = rows(html_text.extract(pages))
    assert {r["page_id"]: (r["url"], r["text"]) for r in got} == want and len(got) == len(want)
    assert all(r["n_chars"] == len(r["text"]) for r in got)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<li>", "<br>", "word ", "&lt;", "<article>", "</article>", "<nav>", "</nav>", "<", "<!--", "-->"]), max_size=40))
def test_no_page_breaks(parts):
    page = "".join(parts)
    text = html_text.main_text(page)
    assert text == " ".join(text.split(" ")).strip(" ")
    assert html_text.main_text(page + "<!-- x -->") == text or "<!--" in page


def test_long_and_deep_pages(spark, empty):
    deep = "<div><b>" * 20_000 + "<article>" + "<p>some words of the text" * 20_000 + "</article>"
    assert html_text.main_text(deep).count("some words of the text") == 20_000
    assert rows(html_text.extract(empty.selectExpr("doc_id AS page_id", "lang AS url", "text AS html"))) == []


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", "<p>Some words</p>", 1), (1, None, None, 2), (None, "v", "<<<", 3)], "page_id long, url string, html string, n_chars int")
    got = rows(html_text.extract(df))
    assert [(r["text"], r["n_chars"]) for r in got] == [("Some words", 10), ("", 0), ("<<<", 3)]


# ---- 4 media


def media_by_force(key, text):
    """Every column of the contract from a text, with the standard library and another reader of images' rows."""
    data = (text or "").encode()
    payload = data + b" " * (192 - len(data) % 192 if len(data) % 192 or not data else 0)
    image = media.encode_image(payload)
    x = list(payload)
    means = [sum(x[c::3]) / (len(x) // 3) for c in range(3)]
    cuts = [int(i * len(x) / 64) for i in range(65)]
    bright = "".join("1" if sum(x[a:z]) / (z - a) > sum(x) / len(x) else "0" for a, z in zip(cuts, cuts[1:]))
    return (key, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), ",".join(f"{m:.4f}" for m in means) + f";{int(bright, 2):016x}")


MEDIA = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def test_media_round_trip(spark, awkward, empty, sample):
    assert rows(media.media_columns(empty)) == []
    for docs, size in ((awkward, 500), (sample, 16_000_000)):
        want = collections.Counter(media_by_force(r["doc_id"], r["text"]) for r in rows(docs))
        assert collections.Counter(tuple(r[c] for c in MEDIA) for r in rows(media.media_columns(docs, range_bytes=size))) == want


@pytest.mark.parametrize("kind", ["string", "decimal(12,2)", "date", "smallint", "binary", "double"])
def test_media_keys_of_any_type(spark, kind):
    value = "DATE'2024-02-29'" if kind == "date" else f"CAST('7' AS {kind})" if kind != "binary" else "X'00FF'"
    docs = spark.sql(f"SELECT {value} AS doc_id, 'some text' AS text UNION ALL SELECT NULL, NULL")
    got = media.media_columns(docs)
    assert got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert {(r["doc_id"], r["n_bytes"]) for r in rows(got)} == {(r["doc_id"], len(r["text"] or "")) for r in rows(docs)}


def test_payloads_stream_in_small_batches(spark, tmp_path):
    docs = spark.createDataFrame([(str(i), "x" * 1000 * (i % 5)) for i in range(50)], "key string, text string").coalesce(1)
    manifest = media.write_archives(docs, str(tmp_path), archive_bytes=6000, range_bytes=1000)
    archives = {r["archive"] for r in rows(manifest)}
    assert 1 < len(archives) < manifest.count()
    reader = media.MediaReader({"path": str(tmp_path), "manifest": manifest._saved_at, "batchBytes": "3000"})
    keys = []
    for part in reader.partitions():
        for b in reader.read(part):
            sizes = [len(x) for x in b.column("payload").to_pylist()]
            assert sum(sizes[:-1]) < 3000
            keys += b.column("key").to_pylist()
    assert sorted(keys, key=int) == [str(i) for i in range(50)]


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=2000))
def test_image_is_lossless(data):
    image = media.encode_image(media.padded(data))
    assert media.decode_image(image) == media.padded(data)
    with pytest.raises(ValueError):
        media.decode_image(image[:40] + bytes([image[40] ^ 255]) + image[41:])


def test_members_are_retried_one_by_one(tmp_path):
    import zipfile

    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("1", b"abc")
    info = zipfile.ZipFile(path).infolist()[0]
    store, p = media.open_fs(path)

    class Flaky:
        fails = 2

        def open_input_file(self, where):
            if Flaky.fails:
                Flaky.fails -= 1
                raise OSError("lost")
            return store.open_input_file(where)

    unsure = iter([False, True, True])

    def decode(data):
        if not next(unsure):
            raise ValueError("not decoded")
        return data * 2

    with media.Members(Flaky(), p, 3, decode) as m:
        assert m.get(info.header_offset, info.file_size, info.CRC) == (b"abc", b"abcabc")
        with pytest.raises(OSError):
            m.get(info.header_offset, info.file_size, info.CRC + 1)
        with pytest.raises(OSError):
            m.entries(info.header_offset, info.header_offset + 50)


def test_more_members_than_an_archive_counts(spark):
    texts = [f"text {i}" * (i % 3) for i in range(50)]
    docs = spark.range(0, 130_000, 1, 1).select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % 50 + 1).cast("int")).alias("text"))
    got = media.media_columns(docs)
    want = {media_by_force(i, t)[1:] for i, t in enumerate(texts)}
    assert {tuple(r[c] for c in MEDIA[1:]) for r in rows(got.select(*MEDIA[1:]).distinct())} == want
    assert got.agg(F.count("*"), F.countDistinct("doc_id"), F.countDistinct("archive")).first() == (130_000, 130_000, 3)


# ---- 5 language model


def naive_logs(texts, train, classes, weights, cfg, voc):
    """log10 probability of each text, word by word and key by key: attention, counts of words and the chain without any array of windows."""
    spell = lambda w: voc.spell(w)
    words = collections.Counter(w for t in train for w in t)
    chain, contexts = collections.Counter(), collections.defaultdict(set)
    for w, c in words.items():
        ids = [voc.end + 1, *spell(w), voc.end]
        for i in range(1, len(ids) - 1):
            for context in ((ids[i],), (ids[i - 1], ids[i])):
                chain[context, ids[i + 1]] += c
                contexts[context].add(ids[i + 1])
    total = collections.Counter()
    for (context, _), c in chain.items():
        total[context] += c
    firsts, types = collections.Counter(), collections.Counter()
    for w, c in words.items():
        firsts[spell(w)[0]] += c
        types[spell(w)[0]] += 1

    def rest(w):
        ids, p = [voc.end + 1, *spell(w), voc.end], 1.0
        for i in range(1, len(ids) - 1):
            q = 1 / (voc.end + 1)
            for context in ((ids[i],), (ids[i - 1], ids[i])):
                m = len(contexts[context]) + 0.5
                q = (chain[context, ids[i + 1]] + m * q) / (total[context] + m)
            p *= q
        m = types[ids[1]] + 0.5
        return (words[w] + m * p) / (firsts[ids[1]] + m)

    x = classes.embedding.astype(float)
    w = {n: a.astype(float) for n, a in weights.items()}

    def gates(given, at):
        low = max(0, (at // lm.BLOCK - 1) * lm.BLOCK)
        own = x[given[at]]
        s = np.array([own @ w["q"] @ (x[given[j]] @ w["k"]) + w["far"][at - j] for j in range(low, at + 1)])
        s = np.exp(s - s.max())
        z = sum(a * (x[given[j]] @ w["v"]) for a, j in zip(s / s.sum(), range(low, at + 1))) + own @ w["x"] + w["b"]
        z = np.exp(z - z.max())
        return z / z.sum()

    out = []
    for t in texts:
        given, log = [voc.begin], 0.0
        for word in t:
            ids = spell(word)
            log += math.log10(gates(given, len(given) - 1) @ classes.first[ids[0]].astype(float)) + math.log10(rest(word))
            given += ids
        out.append(log + math.log10(gates(given, len(given) - 1) @ classes.first[voc.end].astype(float)))
    return out


@pytest.mark.parametrize("cfg", [lm.LmConfig(), lm.LmConfig(group_words=700, bucket_words=100, words_limit=50)])
def test_language_model(spark, sample, monkeypatch, cfg):
    held = {}
    for name in ("fitted_classes", "trained"):

        def keep(*args, made=getattr(lm, name), name=name):
            held[name] = made(*args)
            return held[name]

        monkeypatch.setattr(lm, name, keep)
    docs = sample.filter("length(text) < 4000").limit(80).select("doc_id", "text").unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, "Émile ñandú\x00 zero 𝒳 <|endoftext|> unseenword " + "y" * 700)], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in rows(lm.language_scores(docs, cfg))}
    toks = {r["doc_id"]: lm.split_words(r["text"]) for r in rows(docs)}
    assert set(got) == set(toks)
    out = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in toks}
    train = collections.Counter(w for d, t in toks.items() if not out[d] for w in [*t, b""])
    n, v = sum(train.values()), len(train)
    logs = dict(zip(toks, naive_logs(toks.values(), [t for d, t in toks.items() if not out[d]], held["fitted_classes"], held["trained"], cfg, lm.vocabulary(bpe.default_path()))))
    for d, t in toks.items():
        r, t = got[d], [*t, b""]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[d], len(t), sum(w in train for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
        assert r["score"] == pytest.approx(logs[d], rel=1e-4)


def test_language_model_awkward(spark, awkward, empty):
    assert rows(lm.language_scores(empty)) == []
    got = rows(lm.language_scores(awkward))
    assert len(got) == awkward.count() and all(r["score"] < 0 for r in got)
    copies = [r["score"] for r in got if r["doc_id"] == 2]
    assert copies[0] == copies[1]
    assert next(r for r in got if r["doc_id"] == 4)["n_tokens"] == 1
    nothing = lm.language_scores(spark.createDataFrame([(next(i for i in range(99) if lm.is_held_out(i)), "some words")], "doc_id long, text string"))
    assert [(r["held_out"], r["n_known"], r["train_tokens"]) for r in rows(nothing)] == [(True, 0, 0)]


def test_partitions_agree(spark):
    """Training is averaged over tasks: scores of one task and of five differ by less than 2 % in the mean."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").limit(400)
    one, five = ({r["doc_id"]: r["score"] for r in rows(lm.language_scores(d))} for d in (docs.coalesce(1), docs.repartition(5)))
    assert sum(abs(one[d] - five[d]) for d in one) / sum(abs(s) for s in one.values()) < 0.02


@pytest.fixture(scope="module")
def small_model():
    voc, cfg = lm.vocabulary(bpe.default_path()), lm.LmConfig(classes=4, head=3)
    counts = np.random.default_rng(0).gamma(0.3, 1.0, (voc.size + 1, 4))
    return voc, cfg, lm.Classes(counts, voc.starts, cfg)


def test_first_subwords_are_a_distribution(small_model):
    voc, _, classes = small_model
    assert np.allclose(classes.first.sum(axis=0), 1, atol=1e-4)
    assert not classes.first[: voc.size][~voc.starts[: voc.size]].any()
    assert classes.first.flags.c_contiguous and classes.embedding.flags.c_contiguous and classes.logs.flags.c_contiguous


def test_chain_is_a_distribution():
    rng = np.random.default_rng(1)
    size = 6
    ids, n = rng.integers(0, size, 200), np.full(50, 4)
    keys, counts = lm.word_entries(ids, n, np.ones(50), size)
    c = lm.Chain(keys, counts)

    def mixed(key, lower):
        count, total, many = c.found(key)
        return (count + (many + 0.5) * lower) / (total + many + 0.5)

    t = np.arange(size + 1)
    for b, s in ((1, 2), (size + 1, 3), (5, 5)):
        p = mixed(lm.key3(np.full_like(t, b), np.full_like(t, s), t), mixed(lm.key2(np.full_like(t, s), t), 1 / (size + 1)))
        assert p.sum() == pytest.approx(1)


def test_attention_gradient_and_causality(small_model):
    voc, cfg, classes = small_model
    rng = np.random.default_rng(0)
    starts = np.flatnonzero(voc.starts)
    ids = rng.choice(starts, 150).astype(np.int32)
    ids[rng.random(150) < 0.4] = 300
    a = lm.Attention(classes, cfg)
    for name in a.w:
        a.w[name] = a.w[name] + rng.normal(0, 0.3, a.w[name].shape).astype(np.float32)
    window, target, asked, owner = lm.arrange(ids, np.array([0, 40, 110]), voc)
    parts = list(lm.queries(window, target, asked, 100))
    assert len(parts) == 1 and asked.sum() == (voc.starts[ids]).sum() + 3 and owner.tolist() == [0, 1, 1, 2, 2, 2, 2]
    _, w, place, t, real = parts[0]

    def value():
        p = (a.gates(w, place).astype(float) * classes.first[np.where(real, t, 0)]).sum(axis=2)
        return np.log(p[real]).mean()

    g = a.gradient(w, place, t, real)
    for name in a.w:
        i = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        old, ends = a.w[name][i], []
        for d in (0.02, -0.02):
            a.w[name][i] = old + d
            a.__dict__.pop("tables", None)
            ends.append(value())
        a.w[name][i] = old
        assert (ends[0] - ends[1]) / 0.04 == pytest.approx(g[name][i], rel=0.05, abs=2e-4)
    a.__dict__.pop("tables", None)
    z = a.gates(w, place)
    assert np.allclose(z.sum(axis=2), 1, atol=1e-5)
    later = ids.copy()
    later[-30:] = 220  # what follows does not change what came before
    x, y = a.scores(ids, np.array([0, 40, 110]), voc), a.scores(later, np.array([0, 40, 110]), voc)
    assert x[0] == y[0] and x[1] == y[1] and x[2] != y[2]
    assert np.allclose(a.scores(ids, np.array([0, 40, 110]), voc, batch=2, most=50), x, rtol=1e-5)


def test_words_are_spelt_alike_whatever_is_remembered():
    voc = lm.vocabulary(bpe.default_path())
    words = ["naïve", "a", "zero", "x" * 900, "é", "a", "zebra,", "ß"]
    words = [w.encode() for w in words]
    few, many = lm.Spelling(voc, 2), lm.Spelling(voc, 100)
    for part in (words[:3], words, words[2:]):
        x, y = few.of(part), many.of(part)
        assert (x[0] == y[0]).all() and (x[1] == y[1]).all()
        assert voc.encoding.decode_bytes(x[0].tolist()) == b" " + b" ".join(part)
        assert voc.starts[x[0]].sum() == len(part)
    assert len(set(lm.word_hashes(*many.of(words)).tolist())) == 7 and (many.hash[many.places(words)] == lm.word_hashes(*many.of(words))).all()


def test_sums_in_a_tree(spark):
    from facetmill.llm.suffixes import _pack

    parts = spark.createDataFrame([(n, p, bytearray(_pack(np.array([n, p, 1.0])))) for n in range(0, 700, 7) for p in range(2)], "node long, part int, block binary")
    got = lm.tree_sum(parts, 4)
    assert {p: x.tolist() for p, x in got.items()} == {p: [sum(range(0, 700, 7)), 100.0 * p, 100.0] for p in range(2)}


def test_entry_seen_once_counts(spark):
    """A held-out word scores better where training has it once than where training has its subwords in another order once."""
    word, other = "xq4z7x", "x4qx7z"
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    names = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 10][:20]
    score = {}
    for w in (word, other):
        docs = [(i, f"document {i} has a few plain words") for i in names[1:]] + [(names[0], f"a document that ends in {w}"), (held, word)]
        got = rows(lm.language_scores(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)))
        score[w] = next(r["score"] for r in got if r["doc_id"] == held)
    assert score[word] > score[other] + 0.5


def test_attention_learns_from_every_document(spark, small_model):
    voc, cfg, classes = small_model
    spelling = lm.Spelling(voc, 1000)
    texts = [lm.split_words(f"document {i} has {'some plain ' * (i % 4)}words") for i in range(40)]
    ids = [spelling.of(t)[0] for t in texts]
    docs = spark.createDataFrame([(i % cfg.rounds, bytearray(x.tobytes())) for i, x in enumerate(ids)], "round int, block binary").coalesce(1)
    got = lm.trained(docs, spark.sparkContext.broadcast(classes), cfg, bpe.default_path())
    weights, seen = None, 0
    for r in range(cfg.rounds):
        model, part = lm.Attention(classes, cfg, weights), [x for i, x in enumerate(ids) if i % cfg.rounds == r]
        model.rate = cfg.rate * 0.6**r
        seen += model.train(np.concatenate(part).astype(np.int32), np.array([len(x) for x in part]), voc)
        weights = {n: np.round(a.astype(float), 6) for n, a in model.w.items()}
    assert seen == sum(len(t) + 1 for t in texts)
    assert all(np.allclose(got[n], weights[n], atol=1e-5) for n in got)


# ---- 6 near duplicates


def test_unlucky_sketches_are_verified(spark):
    """Half of the first 64 places of the union in common: seen at a similarity of 80 %, if seldom, so the pair goes on to its full sets."""
    shared, x, y = ([v for v in range(86) if v % 4 in r] for r in ((0, 2), (1,), (3,)))
    sketches = [(i, np.array(sorted(shared + own)[:64], np.uint64).tobytes()) for i, own in ((1, x), (2, y))]
    classes = spark.createDataFrame(sketches, "doc_id long, sketch binary")
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    assert rows(near._estimated(pairs, classes, near.NearConfig())) == [{"a": 1, "b": 2}]


def components_by_force(docs, size, percent=80):
    sets, parent = {}, {}
    for r in docs:
        w = (r["text"] or "").encode().lower().split()
        s = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        if r["doc_id"] is not None:
            sets.setdefault(r["doc_id"], []).append(s)
            parent[r["doc_id"]] = r["doc_id"]

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(s and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}, sets


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_by_force(spark, awkward, empty, size):
    cfg = near.NearConfig(shingle=size, wide=4, enough=60, block=8)
    assert rows(near.near_duplicates(empty, cfg)) == []
    rng = np.random.default_rng(3)
    words = [f"v{i}" for i in range(60)]
    texts, i = [], 100
    for group in range(6):
        first = list(rng.choice(words, 30 + 40 * group))
        for _ in range(25):  # near copies of which some are just beyond the threshold of each other
            t = list(first)
            for k in rng.choice(len(t), max(1, len(t) // 20), replace=False):
                t[k] = str(rng.choice(words))
            texts.append((i, " ".join(t)))
            i += 1
    for n in range(1, 12):
        texts += [(i, " ".join(words[:n])), (i + 1, " ".join(words[1 : n + 1]))]
        i += 2
    docs = awkward.select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id long, text string"))
    want, sets = components_by_force(rows(docs), size)
    got = rows(near.near_duplicates(docs, cfg))
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (want[r["doc_id"]] == r["doc_id"])
            assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}


def test_near_crowded_keys(spark, monkeypatch):
    texts = [(i, "one two three four five six seven eight nine ten " + " ".join(f"z{i % 40}y{j}" for j in range(1 + i % 3))) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    cfg = near.NearConfig(shingle=2, wide=2, block=16)
    want, _ = components_by_force(rows(docs), 2)
    assert {r["doc_id"]: r["component_id"] for r in rows(near.near_duplicates(docs, cfg))} == want


def test_repeated_ids_are_one_node(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (5, "a b c d"), (5, "x y z w"), (7, "x y z w"), (9, "k l m n"), (9, ""), (3, "k l m n"), (12, ""), (12, None), (20, "p q r"), (20, "s t u")], "doc_id long, text string")
    got = rows(near.near_duplicates(docs, near.NearConfig(shingle=2)))
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (5, 1), (7, 1), (9, 3), (3, 3), (12, 12), (20, 20)} and len(got) == 11
    kept = near.keep_one(docs, near.NearConfig(shingle=2))
    assert sorted((r["doc_id"], r["text"] or "") for r in rows(kept)) == [(1, "a b c d"), (3, "k l m n"), (12, ""), (12, ""), (20, "p q r"), (20, "s t u")]


def test_keep_one(awkward):
    kept = near.keep_one(awkward, near.NearConfig(shingle=2))
    ids = [r["doc_id"] for r in rows(kept)]
    assert kept.columns == awkward.columns and ids.count(1) == 1 and 2 not in ids and ids.count(None) == 2


# ---- 7 and 10 tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r\x0b\x0c\x1c\x85\xa0'sdtlve0123²½aAéÀßñ—“…€|%$<>&!."), st.characters(codec="utf-8")), max_size=60))
def test_ids_are_those_of_the_library(text):
    from tokenizers import Tokenizer

    global _T
    if "_T" not in globals():
        _T = Tokenizer.from_file(bpe.default_path())
    want = _T.encode(text, add_special_tokens=False).ids
    b = bpe.load(bpe.default_path())
    assert np.frombuffer(b.ids(text), "<u4").tolist() == want and b.count(text) == len(want)


def test_every_script_is_split_like_the_library(library):
    """Each character of the basic plane after a letter, a digit, a mark and a space: looked up or left to the library, the ids agree."""
    b = bpe.load(bpe.default_path())
    chars = [chr(c) for c in [*range(0x80, 0xD800), *range(0xE000, 0xFFFE), *range(0x1F300, 0x1F700), *range(0x10000, 0x10A00), 0x1FAE9]]
    for a in range(0, len(chars), 200):
        text = "".join(f"a{c}b 1{c}2 !{c}{c} {c}s\u0301" for c in chars[a : a + 200])
        assert np.frombuffer(b.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    words = b.pre_tokens("Привет мир, 世界 123")
    assert words == ["Привет", " мир", ",", " 世界", " 123"] and any(ord(w[-1]) > 0x400 for w in b.whole)


def test_token_counts(spark, awkward, empty, library):
    assert rows(tokens.token_counts(empty)) == []
    exact = spark.createDataFrame([(1, " a" * 1024), (2, " a" * 1025)], "doc_id long, text string")
    assert [(r["n_tokens"], r["over_limit"]) for r in rows(tokens.token_counts(exact))] == [(1024, False), (1025, True)]
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in rows(tokens.token_counts(awkward)))
    want = collections.Counter((r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in rows(awkward))
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in rows(tokens.token_counts(awkward))) == want


def test_packing(awkward, empty, library):
    assert rows(packing.pack(empty)) == []
    got = sorted(rows(packing.pack(awkward)), key=lambda r: (r["sequence_id"], r["offset"]))
    at = {}
    for r in got:
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 2048
    want = collections.Counter()
    for r in rows(awkward):
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        cut = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want.update((r["doc_id"], k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())) for k, (a, z) in enumerate(zip(cut, cut[1:])))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 9), max_size=12))
def test_best_fit_decreasing_by_counts(counts):
    capacity, bins, want = 30, [], []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [i for i, free in enumerate(bins) if free >= length]
            if fits:
                bins[min(fits, key=lambda i: bins[i])] -= length
            else:
                bins.append(capacity - length)
    got, seen = collections.defaultdict(list), collections.Counter()
    for length, a, z, first, each, offset in packing.best_fit_plan(counts, capacity):
        for r in range(a, z):
            got[first + (r - a) // each].append((offset + (r - a) % each * length, length))
            seen[length] += 1
    assert seen == collections.Counter(counts) and len(got) == len(bins)
    assert sorted(capacity - sum(n for _, n in b) for b in got.values()) == sorted(bins)
    for b in got.values():
        end = 0
        for offset, n in sorted(b):
            assert offset == end
            end += n


# ---- 8 weak labels


def test_weak_classifier(spark, awkward, empty, sample, labels):
    assert rows(weak.classify(empty, labels)) == []
    assert len(rows(weak.classify(awkward, labels))) == awkward.count()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = {r["doc_id"]: r["quality"] for r in rows(spark.read.parquet("/root/testdata/sf0.01/labels.parquet")) if not r["toxic"]}
    got = {r["doc_id"]: r["kept"] for r in rows(weak.classify(docs, labels))}
    right = [got[d] == bool(q) for d, q in marks.items()]
    assert sum(right) / len(right) > 0.93


def test_em_recovers_rates():
    rng = np.random.default_rng(5)
    m = len(weak.LABELLERS)
    bad = rng.random(20_000) < 0.3
    hit = np.where(bad[:, None], rng.random((20_000, m)) < 0.7, rng.random((20_000, m)) < 0.01)
    v = np.where(hit, weak.BAD, weak.GOOD)
    patterns, counts = np.unique((v * 3 ** np.arange(m)).sum(axis=1), return_counts=True)
    posterior, rates, share = weak.estimate(patterns, counts.astype(float))
    assert share == pytest.approx(0.3, abs=0.02) and np.allclose(rates[:, 0, weak.BAD], 0.7, atol=0.03)


def test_em_by_force():
    """Votes of single documents, one at a time and without patterns, give the posteriors that counted patterns give."""
    rng = np.random.default_rng(6)
    m, n = len(weak.LABELLERS), 150
    v = rng.integers(0, 3, (n, m))
    v[:50] = np.where(v[:50] == weak.BAD, weak.GOOD, v[:50])
    bad = [0.95 if weak.BAD in row else 0.02 for row in v.tolist()]
    for _ in range(7):
        total = [[[2.0, 2.0, 1.0], [0.2, 20.0, 1.0]] for _ in range(m)]
        for row, b in zip(v.tolist(), bad):
            for i, x in enumerate(row):
                total[i][0][x] += b
                total[i][1][x] += 1 - b
        share = (sum(bad) + 1) / (n + 2)
        new = []
        for row in v.tolist():
            p = [share, 1 - share]
            for i, x in enumerate(row):
                p = [p[c] * total[i][c][x] / sum(total[i][c]) for c in (0, 1)]
            new.append(p[0] / sum(p))
        bad = new
    patterns, at, counts = np.unique([weak.pattern(row) for row in v.tolist()], return_inverse=True, return_counts=True)
    got, _, _ = weak.estimate(patterns, counts.astype(float), 7)
    assert np.allclose(got[at], bad, atol=1e-9)


def test_scores_by_force(spark, sample, labels):
    """The registered scores are those of whole texts measured, voted and scored one by one."""
    cfg = weak.WeakConfig()
    got = {r["doc_id"]: r for r in rows(weak.classify(sample, labels, cfg))}
    stems = weak.by_length(weak.lexicon.learn_stems(sample.select("doc_id", "text"), labels, weak.lexicon.sample_share(labels, cfg.lexicon_rows)))
    places, read = weak.Features(cfg.bits), []
    for r in rows(sample):
        m, low = weak.measures(r["text"] or "", stems)
        read.append((r["doc_id"], weak.pattern(weak.votes(m, len(low))), np.array(sorted(places.of(m, low)), np.int32)))
    patterns, counts = np.unique([p for _, p, _ in read], return_counts=True)
    bad, _, _ = weak.estimate(patterns, counts.astype(float))
    good = dict(zip(patterns.tolist(), (1 - bad).tolist()))
    order = sorted(read, key=lambda x: (x[2].tobytes(), x[1]))
    w = weak.fit([x[2] for x in order], np.array([good[x[1]] for x in order]), cfg)
    for d, p, at in read:
        z = sum(float(w[i]) for i in at) + float(w[-1])
        assert got[d]["posterior"] == pytest.approx(good[p], abs=1e-9) and got[d]["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)
        assert got[d]["kept"] == (got[d]["score"] >= 0.5)


# ---- 9 suffixes


def removed_by_force(docs, length):
    seen, out = {}, []
    texts = [((1 << 63) - 1 if r["doc_id"] is None else r["doc_id"], (r["text"] or "").encode()) for r in docs]
    for i, b in texts:
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            seen[s] = min(seen.get(s, i), i)
    for i, b in texts:
        cut = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] < i:
                cut[p : p + length] = True
        kept = bytes(x for x, c in zip(b, cut) if not c)
        out.append((i, len(b), int(cut.sum()), int((np.diff(np.concatenate(([0], cut.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("flush", [3_000_000, 50])
def test_repeats_by_force(spark, awkward, empty, flush):
    cfg = suffixes.SuffixConfig(flush=flush)
    assert rows(suffixes.repeat_report(empty, cfg)) == []
    rng = np.random.default_rng(9)
    part = lambda n: "".join(rng.choice(list("ab cé"), n))
    shared = [part(n) for n in (49, 50, 51, 80, 400)]
    texts = [(200 + i, part(int(rng.integers(0, 90))) + shared[i % 5] + part(int(rng.integers(0, 60))) + (shared[(i + 1) % 5] if i % 2 else "")) for i in range(40)]
    texts += [(300, "ab" * 200), (301, "ab" * 150), (302, "a" * 120), (303, "a" * 49)]
    docs = awkward.filter("length(text) < 6000 or text is null").select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id long, text string"))
    got = rows(suffixes.repeat_report(docs, cfg))
    assert collections.Counter(((1 << 63) - 1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == removed_by_force(rows(docs), 50)


def test_bytes_before_the_anchor_are_compared(monkeypatch, spark, awkward):
    """With a hash that takes all bytes before the anchor for one another, the result is the same."""
    mix = suffixes._mix
    monkeypatch.setattr(suffixes, "_mix", lambda x: mix(x) if len(x) > 3000 else mix(x) * np.uint64(0))
    test_spans_by_force()


def test_spans_by_force():
    cfg = suffixes.SuffixConfig()
    rng = np.random.default_rng(4)
    core = bytes(rng.integers(97, 100, 60).tolist())
    texts = [bytes(rng.integers(97, 99, 30).tolist())[-int(k):] + core for k in rng.integers(1, 30, 40)]
    rows_of = []
    for i, t in enumerate(texts):
        p = len(t) - 60 + 5
        wide = b"\0" * cfg.reach + t + b"\0" * cfg.length
        rows_of.append((np.frombuffer(wide[p : p + cfg.reach], np.uint8)[::-1], np.frombuffer(wide[p + cfg.reach : p + cfg.reach + cfg.length], np.uint8), i, p, min(p, cfg.reach), min(len(t) - p, cfg.length)))
    rows_of.sort(key=lambda r: r[1].tobytes())
    same, rest = suffixes.front_code(np.stack([r[1] for r in rows_of]))
    ids, at = np.array([r[2] for r in rows_of], "<i8"), np.array([r[3] for r in rows_of], "<u4")
    block = suffixes._pack(same, rest, np.stack([r[0] for r in rows_of]), np.array([r[4:] for r in rows_of], np.uint8), ids, np.zeros(len(ids), "<u8"), at)
    import pyarrow as pa

    out = suffixes._spans(1, cfg)(pa.table({"block": pa.array([block], pa.binary())}))
    got = collections.defaultdict(set)
    for b in out.column("block").to_pylist():
        i, _, a, z = suffixes._unpack(b, "<i8", "<u8", "<u4", "<u4")
        for k, s, e in zip(i.tolist(), a.tolist(), z.tolist()):
            got[k] |= set(range(s, e))
    for i, t in enumerate(texts):
        p = len(t) - 60 + 5
        want = set()
        for o in range(cfg.reach + 1):
            s = t[p - o : p - o + 50]
            if p >= o and len(s) == 50 and any(len(u) - 55 >= o and u[len(u) - 55 - o : len(u) - 5 - o] == s for u in texts[:i]):
                want |= set(range(p - o, p - o + 50))
        assert got[i] == want


def test_stripped_documents(awkward):
    out = suffixes.strip_repeats(awkward)
    assert out.columns == awkward.columns and 2 not in [r["doc_id"] for r in rows(out)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=4, max_size=4).map(lambda b: bytes(x % 3 for x in b)), max_size=12), min_size=1, max_size=6))
def test_loser_tree_merges_with_common_prefixes(lists):
    runs = []
    for r in lists:
        r = sorted(set(r))
        same = [0] + [next(i for i in range(4) if a[i] != b[i]) for a, b in zip(r, r[1:])]
        runs.append((r, same))
    out = [(runs[r][0][i], h) for r, i, h in suffixes.LoserTree(runs)]
    words = [w for w, _ in out]
    assert words == sorted(w for r in lists for w in set(r))
    for (a, _), (b, h) in zip(out, out[1:]):
        assert h == next((i for i in range(4) if a[i] != b[i]), 4)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(min_size=5, max_size=5).map(lambda b: bytes(x % 2 for x in b)), min_size=1, max_size=30))
def test_front_coding(words):
    x = np.array([list(w) for w in sorted(words)], np.uint8)
    assert (suffixes.front_decode(*suffixes.front_code(x), 5) == x).all()


def test_pieces_do_not_change_anchors_or_words():
    rng = np.random.default_rng(2)
    data = bytes(rng.choice(list(b"abc \n"), 5000).tolist())
    offsets = np.array([0, 0, 1000, 1049, 3000, 5000])
    cfg = suffixes.SuffixConfig()
    whole = suffixes.anchors(np.frombuffer(data, np.uint8), offsets, cfg)
    parts = suffixes.anchors(np.frombuffer(data, np.uint8), offsets, cfg, 333)
    assert all((a == b).all() for a, b in zip(whole, parts))
    assert all((a == b).all() for a, b in zip(near.word_hashes(data, offsets), near.word_hashes(data, offsets, 100)))
