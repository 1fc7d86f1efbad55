"""Operators on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables; against brute force."""

import hashlib
import json
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonearm.llm import bpe, chunks, common, decontaminate, dedup_exact, graph, html_text, jaccard_join, licenses, stages, substrings, token_files, toxicity, url_filter

from . import brute

LONG = "word " * 40_000
ODD = [(1, None), (2, ""), (3, " "), (4, "a"), (5, "A b  c\n\nd "), (6, "same text here for two"), (7, "same text here for two"), (7, "same text here for two"), (None, "no id"), (8, LONG), (9, "é ü 日本 🎉 <|endoftext|> don't")]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


# 1 and 10
def test_token_files(spark, docs, library):
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids + [0]
    ordered = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    for rows in (ordered, ODD[::-1]):  # in order, and to be put in order
        path = common.scratch_path(spark, "t")
        token_files.write_tokens(docs(rows).repartition(3) if rows is not ordered else docs(rows).coalesce(1), path)
        got = {(r["doc_id"], r["start"]): r for r in token_files.read_tokens(spark, path).collect()}
        at = 0
        for doc_id, text in ordered:
            assert got[doc_id, at]["ids"] == ids(text)
            at += len(ids(text))
        assert sum(r["ids_crc32"] for r in token_files.token_digests(spark, path).collect()) == sum(zlib.crc32(np.array(ids(t), "<u4").tobytes()) for _, t in ODD)


def test_token_files_empty(spark, docs):
    path = common.scratch_path(spark, "t")
    token_files.write_tokens(docs([]), path)
    assert token_files.token_digests(spark, path).count() == 0


def test_code_lengths():
    rng = np.random.default_rng(1)
    for n, limit in ((1, 4), (2, 4), (16, 4), (300, 9), (1000, 20)):
        counts = (rng.pareto(0.5, n) * 3 + 1).astype(np.int64)
        lengths = token_files.code_lengths(counts, limit)
        assert lengths.max() <= limit and (0.5 ** lengths[lengths > 0]).sum() <= 1
        coder = token_files.Coder(lengths)
        ids = rng.integers(0, n, 5000)
        payload, lanes = coder.encode(ids)
        assert (coder.decode(payload, lanes, len(ids)) == ids).all()
        assert (coder.decode(payload, lanes, 700, first_lane=2) == ids[512:1212]).all()


def test_bpe(docs, library):
    got = {(r["doc_id"], r["n_tokens"]): r for r in bpe.round_trip(docs(ODD)).collect()}
    for doc_id, text in ODD:
        ids = library.encode(text or "", add_special_tokens=False).ids
        row = got[doc_id, len(ids)]
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    encoded = bpe.encode_documents(docs(ODD))
    assert rows_of(bpe.decode_documents(encoded)) == rows_of(docs([(i, t or "") for i, t in ODD]).select("doc_id", "text"))
    assert bpe.round_trip(docs([])).count() == 0


def test_bpe_random(library):
    codec, rng = bpe.Codec.of(bpe.read_vocabulary()), random.Random(2)
    parts = ["a", "the", "ing", "é", "日", " ", "  ", "\n", ".", ",", "%%", "'s", "12", "\x01", "\t", "<|endoftext|>", ">", " ", "\x1c"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)]
    assert codec.encode(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_memo_bounds(monkeypatch, library):
    monkeypatch.setattr(chunks, "MEMO_PIECES", 4)
    monkeypatch.setattr(chunks, "GROUP_BYTES", 200)
    codec = bpe.Codec(bpe.read_vocabulary())
    texts = [f"w{k} " + "long" * 30 for k in range(30)]
    assert codec.encode(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(codec.encoder.pieces) < 12


def test_long_words(library):
    codec, rng = bpe.Codec.of(bpe.read_vocabulary()), random.Random(5)
    texts = ["".join(rng.choices("etaoinshrdlu", k=n)) for n in (49, 500, 20_000)] + ["abcdefghij" * 3000, "=" * 5000, " " * 5000 + "x"]
    assert codec.encode(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_tokenizers_are_not_cut():
    plain = json.loads(bpe.read_vocabulary())
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}):
        assert not chunks.cuttable(json.dumps(plain | change))
        with pytest.raises(ValueError):
            bpe.Codec(json.dumps(plain | change))


# 2
URLS = [None, "", "no scheme", "http://", "http://org/", "http://A.Example.ORG/es/1?q#f", "https://example.org/en/12", "http://x.com/fr/", "http://x.com/de/1", "http://casino.net/", "http://q.net", "http://notexample.org/es/", "http://x.org?/es/", "ftp://u@h.com:80/fr/x"]


def plain_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    listed = any(w in url_filter.HOST_WORDS for w in re.split("[.-]", host))
    return host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "block" if listed else "allow"


@pytest.mark.parametrize("bits", [1 << 27, 0])
def test_urls(spark, bits):
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(URLS)], "page_id long, url string, host string")
    assert rows_of(url_filter.judge(pages, url_filter.RULES, max_bits=bits)) == sorted(((k, *plain_url(u)) for k, u in enumerate(URLS)), key=repr)
    assert url_filter.judge(pages.limit(0), url_filter.RULES).count() == 0


def test_cascade_is_exact(spark):
    universe = url_filter._hashed(spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key")))
    listed = universe.where("cast(substring(key, 2) as int) % 7 = 0")
    cascade = url_filter.build_cascade(universe, listed)
    pdf = universe.toPandas()
    assert (cascade.listed(pdf["a"].to_numpy(), pdf["b"].to_numpy()) == (pdf["key"].str[1:].astype(int) % 7 == 0)).all()


def test_url_table(spark):
    rng = random.Random(11)
    hosts = [f"{rng.choice('abc')}{k % 500}.{rng.choice(['net', 'info', 'com'])}" for k in range(3000)]
    pages = spark.createDataFrame([(k, f"http://{'www.' * (k % 2)}{h}/fr/x") for k, h in enumerate(hosts)], "page_id long, url string")
    table = spark.range(100_000).select(F.concat(F.lit("A"), F.col("id").cast("string"), F.lit(".net")).alias("host"))
    for bits in (1 << 27, 100):
        got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, url_filter.RULES, max_bits=bits, blocked=table).collect()}
        for k, h in enumerate(hosts):
            assert got[k] == (("com/fr/", "allow") if h.endswith(".com") else (None, "block" if h[0] == "a" and h.endswith(".net") else "allow")), h


# 3
def test_toxicity(spark, docs):
    rng = random.Random(4)
    fine = [f"w{k}x" for k in range(200)]
    rows = []
    for i in range(400):
        ws = rng.choices(fine, k=40)
        if i % 4 == 0:
            ws[5], ws[9] = rng.choice(["idiotic", "worthless"]), f"bloru{rng.choice('abcdef')}"
        rows.append((i, " ".join(ws)))
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    d = docs(rows)
    model = toxicity.train(d, labels)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score_documents(d, model).collect()}
    assert all((scored[i] >= 0.5) == (i % 4 == 0) for i in range(400))
    odd = docs([(1, None), (2, ""), (3, "worthles " + " ".join(fine[:20])), (4, LONG), (None, "x")])
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(odd, model).collect()}
    assert got[1] == got[2] < 0.5 and got[3] > got[1]
    assert toxicity.clean_documents(d, model).count() == 300
    none = toxicity.train(d, labels.limit(0))
    assert {round(r["score"], 6) for r in toxicity.score_documents(odd, none).collect()} == {toxicity.BASE_SCORE}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_automaton():
    terms, rng = ["idiot$", "worthless$", "scum$", "lowei"], random.Random(6)
    a = toxicity.Automaton(terms)
    for _ in range(3000):
        w = list(rng.choice(["idiot", "worthless", "scum", "loweichen", "idea"]))
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, len(w))
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "i"])
        w = "".join(w)
        best = [edit_distance(w, t[:-1]) if t[-1] == "$" else min(edit_distance(w[:n], t) for n in range(len(w) + 1)) for t in terms]
        fits = [(d, k) for k, d in enumerate(best) if d <= toxicity.allowed_edits(terms[k])]
        got = a.match(w)
        assert (got is None) == (not fits) and (not fits or got[1] == min(fits)[0]), w


def test_quoted():
    matcher = toxicity.Matcher(["idiot$"])
    quoted = lambda t: [q for *_, q in toxicity.hits_in(matcher, t)]
    assert quoted('He wrote: "you idiot, go away" and left, an idiot.') == [True, False]
    assert quoted('"a" then you idiot and "b"') == [False]
    assert quoted("„du idiot“ “idiot” «idiot» idiot”") == [True, True, True, False]
    assert quoted('an open " mark\nidiot "') == [False]
    assert quoted("she said idiot") == [True]


# 4
def test_decontamination(spark, docs):
    rng = random.Random(7)
    word = lambda: rng.choice(["a", "b", "c", "É", "x1"])
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 5, 13, 14, 30, 40])] + [(6, None), (7, ""), (4, "repeated id " * 9)]
    rows = ODD[:-3] + [(10 + k, " ".join([*(word() for _ in range(30)), *(items[k % 6][1].upper().replace(" ", ", ").split(" ")), *(word() for _ in range(k * 9))])) for k in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute.contaminated(rows, items), key=repr)
    for block in (1_000_000, 20):
        found = decontaminate.contamination(decontaminate.find_matches(docs(rows), bench, block_words=block))
        got = found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long"), F.sha2(F.array_join("item_ids", ","), 256), "contaminated")
        assert rows_of(got) == want
    assert not any(r["contaminated"] for r in decontaminate.contamination(decontaminate.find_matches(docs(rows), bench.limit(0))).collect())


# 5
def plain_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_rows(seed, bases, copies, n_words, edits):
    rng, rows = random.Random(seed), []
    for _ in range(bases):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(*n_words))]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randint(0, edits)):
                t[rng.randrange(len(t))] = f"z{rng.randint(0, 9)}"
            rows.append((len(rows), " ".join(t)))
    return rows


@pytest.mark.parametrize("frequent", [48, 2])
def test_jaccard(docs, monkeypatch, frequent):
    monkeypatch.setattr(jaccard_join, "MIN_FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 16)
    rows = near_rows(1, 12, 12, (4, 60), 5) + [(2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2004, "ONE"), (2005, "a b c d e"), (2006, LONG), (2007, LONG + "x")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs(rows)).collect()}
    assert got == plain_components(rows)


def test_jaccard_odd_rows(docs):
    with pytest.raises(TypeError):
        jaccard_join.near_duplicates(docs([(1, "a")]).withColumn("doc_id", F.lit("x")))
    same = [(9, "q r s t u v w"), (5, "q r s t u v w"), (9, "other words here"), (4, "other words here")]  # one identifier on two texts links both
    assert {r[2] for r in rows_of(jaccard_join.near_duplicates(docs(same)))} == {4}
    got = rows_of(jaccard_join.near_duplicates(docs([(1, "a b c"), (1, "a b c"), (None, "a b c"), (3, "x")])))
    assert [r for r in got if r[0] == 1] == [(1, 1, 1)] * 2 and (3, 1, 3) in got and len(got) == 4
    assert jaccard_join.near_duplicates(docs([])).count() == 0


def test_jaccard_keys_reach_every_link():
    """Sets that link share a key by which either expects a set of the other's size."""
    rng = np.random.default_rng(3)
    linked = 0
    for _ in range(2000):
        n = int(rng.integers(4, 60))
        pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        x, y = (np.unique(np.concatenate([pool[:n], pool[n : n + k]])[lo:]) for k, lo in zip(rng.integers(0, n // 4 + 1, 2), rng.integers(0, n // 6 + 1, 2)))
        if len(x) < 4 or len(y) < 4 or len(np.intersect1d(x, y)) < jaccard_join.needed(len(x), len(y)) or np.array_equal(x, y):
            continue
        linked += 1
        often = rng.integers(0, 4) * (1 << 61)
        (kx, mx), (ky, my) = (jaccard_join.index_keys(z, z < often) for z in (x, y))
        _, i, j = np.intersect1d(kx, ky, return_indices=True)
        assert ((mx[i] >= len(y)) & (my[j] >= len(x))).any()
    assert linked > 300


def test_jaccard_rows_between_texts_that_cannot_link(docs, monkeypatch):
    """Texts of too different lengths share no bucket, and texts that bitmaps tell apart are looked at in one round alone."""
    real, rows = common.stored, []

    def stored(df, name, **options):
        out = real(df, name, **options)
        rows.append((name, out.count()))
        return out

    monkeypatch.setattr(common, "stored", stored)
    own = lambda k, n: " ".join(f"v{k}x{i}" for i in range(n))
    lengths = [(k, f"these five words stand here {own(k, 4 * 2**k)}") for k in range(6)]
    assert jaccard_join.near_duplicates(docs(lengths)).where("component_id <> doc_id").count() == 0
    assert dict(rows)["shingle-index"] == 0
    rows.clear()
    far = [(k, " ".join(f"p{i}" for i in range(60)) + " " + own(k, 25)) for k in range(20)]  # half of the shingles are common
    near = [(100 + k, own(99, 40) + f" {k} {k}") for k in range(3)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(docs(far + near)).collect()}
    assert got == {k: min(k, 100) for k, _ in far + near}
    looked = [n for name, n in rows if name == "jaccard-rooted"]
    assert looked[0] > 0 and sum(looked[1:]) < looked[0], looked


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert rows_of(graph.components(df)) == rows_of(graph.components(df, small=0))


# 6
def plain_copies(rows, largest=True):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return groups


def test_exact(docs):
    got = dedup_exact.exact_duplicates(docs(ODD), keep="max").collect()
    groups = plain_copies(ODD)
    assert len(got) == len(ODD) and sum(r["kept"] for r in got) == len(groups)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    assert {r["keep_id"] for r in dedup_exact.exact_duplicates(docs(ODD[5:8])).collect()} == {6}
    assert dedup_exact.exact_duplicates(docs([])).count() == 0


def test_exact_batches(spark, docs, monkeypatch):
    monkeypatch.setattr(dedup_exact, "FANOUT", 2)
    rng, seen, index = random.Random(4), {}, dedup_exact.DigestIndex("max")
    for batch in range(5):
        rows = [(100 * batch + k, rng.choice(["a", "b", "c", "", None, "d" * 9, f"own {batch} {k}"])) for k in range(12)]
        for i, t in rows:
            seen.setdefault(t or "", []).append(i)
        got = {r["doc_id"]: r for r in index.add(docs(rows)).collect()}
        for i, t in rows:
            ids = seen[t or ""]
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(ids), len(ids), i == max(ids)), (batch, i, t)
        assert len(got) == len(rows)
    assert [len(level) for level in index.levels] == [1, 0, 1]
    run = index.levels[2][0]
    other = spark.range(2000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    assert run.passing(run.entries).count() == run.entries.count() and run.passing(other).count() < 400


# 7
def test_html(spark):
    page = lambda k: f"<html><body><nav>menu</nav><header>top</header><div class='promo-box'>ad</div><article><h1>T&amp;{k}</h1><p>one<b>two</b>\n three<br>x<p>Follow our channel<script>no()</script></article><aside>s</aside><footer>f</footer></body>"
    rows = [(k, "http://h.org/x", page(k), "h") for k in range(12)] + [(50, None, None, "h"), (51, "bad", "<p>a &lt;b&gt;&nbsp; c</p><!-- x --><p>d <i", "h"), (52, "http://q.org", "", "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in html_text.main_texts(pages).collect()}
    assert got[3]["text"] == "T&3" and got[50]["text"] == "" and got[51]["text"].startswith("a <b> c d")  # paragraphs of all twelve texts are templates
    few = {r["page_id"]: r["text"] for r in html_text.main_texts(pages.where("page_id < 5")).collect()}
    assert few[3] == "T&3 onetwo three x Follow our channel"
    assert html_text.main_texts(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "source, text",
    [
        ("<article><h2 id='related-work'>Related</h2><h2 class='search'>Search</h2><p>a</article>", "Related Search a"),
        ("<article class='post comments-open'><p>a</article><p>b", "a"),
        ("<article class='comments'><p>a</article><p>b", "a"),
        ("<div class='content-sidebar-wrap'><p>a</div>", "a"),
        ("<p data-id='share-7' title='x class=ad'>a</p><p data-id=share>b", "a b"),
        ("<div class='widget'><p>x</p><form><main><p>a</main></form></div><p>b", "a"),
        ("<form><nav>n</nav><div class='ad'>d</div><article><p>a</article></form>", "a"),
        ("<p>skip</p><form><h1>t</h1><p>a</form>", "skip t a"),
        ("<form><p>a</form>", "a"),
        ("<p>a</p><form><p>b</form><div class='big AD'>c</div><div id=sidebar>d</div><div role='search'>e</div>", "a"),
        ("<article><p>a</p><div class='comments'><article>c</article></div><form>f</form></article>", "a"),
        ("<aside><article>x</article></aside><article>a</article>", "a"),
        ("<div class='layout with-sidebar'><article><p>a</article></div>", "a"),
        ("<div id='search-page'><main><p>a</main></div>", "a"),
        ("<form id='aspnetForm'><article><p>a</article></form>", "a"),
        ("<main><p>a long text</p><article>card</article></main>", "a long text card"),
        ("<main><p>x</p><article>a long text</article></main>", "a long text"),
    ],
)
def test_html_marks(source, text):
    assert html_text.Page(f"<html><body>{source}</body></html>").text() == text


def test_html_is_linear():
    began = time.time()
    for source in ("<a " * 350_000, "<div>" * 100_000, "<p>" * 100_000, "<li>x" * 100_000, "<i>" * 50_000 + "</b>" * 50_000, "<! " * 300_000, "<div><p>x" * 50_000, "<a '" * 100_000):
        html_text.Page(source).text()
    assert time.time() - began < 30


def test_inline_elements_are_no_templates(spark):
    rows = [(k, "http://h.org/x", f"<article><p>Words {k} of the <b>same name</b> stay.</p><p>Follow our channel</p></article>") for k in range(12)]
    got = [r["text"] for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(got) == sorted(f"Words {k} of the same name stay." for k in range(12))


# 8
@pytest.mark.parametrize("hot, bound, pairs", [(20_000, 500_000, 48), (5, 0, 2)])
def test_substrings(docs, monkeypatch, hot, bound, pairs):
    monkeypatch.setattr(substrings, "HOT_ANCHORS", hot)
    monkeypatch.setattr(substrings, "BROADCAST_RANGES", bound)
    monkeypatch.setattr(substrings, "PAIRS", pairs)
    rng = random.Random(3)
    junk = lambda n: "".join(rng.choices("abcdef é", k=n))
    base = junk(800)
    rows = [(k, junk(rng.randint(0, 300)) + base[rng.randint(0, 200) : rng.randint(450, 800)] + junk(rng.randint(0, 300))) for k in range(40)]
    rows += [(100, None), (101, ""), (102, base), (102, base), (103, "é" * 600), (104, "ab " * 300), (105, "x" * 399)]
    got = substrings.removed(substrings.repeated_spans(docs(rows)))
    assert rows_of(got.select(got.columns[:5])) == sorted(brute.removed(rows), key=repr)
    assert got.where("repeats <> (n_removed > 0) or removed_share <> n_removed / greatest(n_bytes, 1)").count() == 0
    assert substrings.removed(substrings.repeated_spans(docs([]))).count() == 0


# 9
def plain_scan(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split()]
    at = [k for k, _ in places]
    found = {label for _, label in places}
    for line in (text or "").split("\n"):
        have = set(common.words(line))
        found |= {label for label, t in licenses.TEMPLATES if len(have & set(common.words(t))) >= licenses.THRESHOLD * len(set(common.words(t)))}
    return len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(found))


def test_licenses(docs):
    texts = [None, "", "MIT License, mit license", "cc by cc by", "x\nPermission is hereby granted free of charge to any person obtaining a copy of this software and files\ny", "Mozilla Public License", "GNU general\npublic license é", LONG, licenses.TEMPLATES[1][1]]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: tuple(r)[1:7] for r in licenses.scan_licenses(docs(rows)).collect()}
    assert got == {i: plain_scan(t) for i, t in rows}
    assert licenses.scan_licenses(docs([])).count() == 0


def plain_windows(text):
    """Every window of every template, counted anew."""
    ws, found = common.words(text), set()
    for label, t, key in [*((label, t, "") for label, t in licenses.TEMPLATES), *licenses.GRANTS]:
        tokens, width = set(common.words(t)), -(-len(common.words(t)) * 5 // 4)
        for k in range(len(ws)):
            have = tokens.intersection(ws[k : k + width])
            if 5 * len(have) >= 4 * len(tokens) and have.issuperset(common.words(key)):
                found.add(label)
    return found


def test_license_wordings(docs):
    wanted = {
        "Intro. All rights\nreserved. More": "all-rights-reserved",
        "This is released, under the MIT\nsoftware license, to all": "mit",
        "Under the License of Apache, version 2.0, licensed": "apache",
        "x y\nlicensed under\nCC (BY, NC) 4.0": "cc-by,cc-by-nc",
        "this work is under version 3 of the GNU public general license": "gpl",
        "Permission is hereby granted, free of charge,\nto any person obtaining a copy\nof this software and files": "mit",
        "released under the new license": "",
        "all the people said that their rights were not being reserved": "",
    }
    rng = random.Random(8)
    parts = [w for _, t, _ in licenses.GRANTS for w in t.split()]
    texts = [*wanted, *(" ".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(150)), *(" ".join(rng.sample(t.split(), len(t.split()))) for _, t in licenses.TEMPLATES)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        lines = set(plain_scan(t)[5].split(",")) - {""}
        assert got[i]["labels"] == ",".join(sorted(lines | plain_windows(t))), t
        assert got[i]["base_labels"] == plain_scan(t)[4]
    assert [got[i]["labels"] for i in range(len(wanted))] == list(wanted.values())
    assert 0.8 <= got[1]["score"] <= 1


def test_license_places_are_linear():
    text = "cc by " * 100_000
    began = time.time()
    n = licenses.Scanner(licenses.TEMPLATES, {}, 0.8, licenses.PHRASES).scan(text)
    assert n[1:4] == (100_000, 0, 199_998) and time.time() - began < 10


# pipeline
def test_stages(spark, docs, tmp_path):
    bench = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "alpha beta gamma delta epsilon zeta eta theta"), (2, "alpha beta gamma delta epsilon zeta eta theta"), (3, bench), (None, "null id"), (4, None)] + [(10 + k, " ".join(f"w{n}" for n in range(200)) + end) for k, end in enumerate(("", " x", " y"))]
    rows += [(7, "a copied text"), (7, "another text under its identifier"), (9, "a copied text")]
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    d, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in stages.STAGES[:-1]:
        columns = d.columns
        d = common.stored(stage(spark, d, str(tmp_path)), "t")
        assert d.columns == columns
        kept.append(sorted((r["doc_id"] for r in d.collect()), key=repr))
    assert kept[0] == sorted((i for i, _ in rows), key=repr)
    assert kept[1] == sorted([2, 3, 4, 7, 9, 10, 11, 12, None], key=repr)
    assert kept[2] == sorted([2, 3, 4, 7, 9, 10, None], key=repr)
    assert kept[3] == sorted([2, 4, 7, 9, 10, None], key=repr)
    assert stages.run(spark, str(tmp_path)).count() == 6
