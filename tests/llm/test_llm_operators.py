"""The ten operators against brute force, round trips and held-out accuracy, and on odd inputs."""

import html as html_lib
import random
import re
import textwrap
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from veritrace.llm import decontaminate, html_extract, jaccard, langid, licenses, masked_lm, mixing, quality_model, quality_rules, token_prefix

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names operators use themselves.
EXTRA = DOCS + ", score double, n int, a long, bucket int, tokens string, rate double, host string, k int, label int"
WORDS = [a + b for a in ("ba", "ce", "di", "fo", "gu", "ha") for b in ("n", "rt", "sk", "l", "mp", "x")]


def frame(spark, texts, schema=DOCS, ids=None):
    width = len(schema.split(","))
    rows = [((ids[k] if ids else k), t, "en", "s", None if t is None else len(t), *[None] * (width - 5)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def odd_texts(seed=0):
    r = random.Random(seed)
    long_ = prose(r, 4000)
    return [None, "", " \t\n", "one", "a b c d", "!!!", "é 日本 x\x1cy", long_, long_, long_ + " end", prose(r, 60), prose(r, 60).upper(), "the " * 50]


# --- 1: decontamination


def benchmark(spark, texts, ids=None):
    return spark.createDataFrame([((ids[k] if ids else k), t) for k, t in enumerate(texts)], "item_id long, text string")


def decontaminated(df):
    return sorted(map(repr, ((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.digest(df).collect())))


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 300])
def test_decontamination_is_exact(spark, block):
    r = random.Random(3)
    items = [prose(r, 25), prose(r, 10), "Ba-n, Cert!", "single", None, "", "...", prose(r, 12), prose(r, 12)]
    items[8] = items[7]
    docs = odd_texts() + [items[0], "x " + items[1].upper() + " y", "ban cert", "no single here", prose(r, 30) + " " + " ".join(items[0].split()[3:14]), " ".join(items[0].split()[:9]), items[7]]
    docs.append(docs[-1])
    found = decontaminate.contamination(frame(spark, docs, EXTRA), benchmark(spark, items), block_bytes=block)
    assert decontaminated(found) == sorted(map(repr, decontaminate.brute_force(list(enumerate(docs)), list(enumerate(items)))))


def test_decontamination_of_empty_tables(spark):
    docs, none = frame(spark, ["a b c"]), frame(spark, [])
    assert decontaminated(decontaminate.contamination(docs, benchmark(spark, [])))[0].endswith("False)")
    assert decontaminate.contamination(none, benchmark(spark, ["a b"])).count() == 0
    kept = decontaminate.keep_clean(frame(spark, ["a b c", "z", None], EXTRA), benchmark(spark, ["a b"]))
    assert kept.columns == frame(spark, [], EXTRA).columns and {r.text for r in kept.collect()} == {"z", None}


# --- 2: language


def test_language_by_held_out_accuracy(spark):
    r = random.Random(5)
    sound = {"aa": "bcdfg", "bb": "lmnpr", "cc": "stvwx"}
    rows = []
    for k in range(300):
        lang = r.choice(list(sound))
        rows.append((k, " ".join("".join(r.choice(sound[lang]) + r.choice("aeiou") for _ in range(3)) for _ in range(20)), lang if k % 11 else None))
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 + 3!", "cc"), (3, rows[3][1], rows[3][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(langid.learnable(docs), rows=200)
    got = {(r_.doc_id, r_.lang_pred): r_ for r_ in langid.digest(langid.predicted(docs, model)).collect()}
    by_id = {k[0]: v for k, v in got.items()}
    tested = [(k, lang) for k, _, lang in rows[:300] if lang and zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(by_id[k].held_out for k, _ in tested)
    assert np.mean([by_id[k].lang_pred == lang for k, lang in tested]) > 0.97
    assert all(by_id[k].lang_pred == "und" and by_id[k].score == 0 for k in (900, 901, 902))
    assert all(0 <= v.score <= 1 for v in by_id.values()) and model.temperature > 0


def test_numbers_are_no_letters():
    model = langid.Model(["aa"], np.zeros((1 << langid.BITS, 2), np.float32), np.zeros(1), 1.0)
    assert model.predict(["½ ² Ⅷ 12", "½ a"])[0] == ["und", "aa"]


def test_language_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.fit(none)
    assert langid.predicted(none, model).count() == 0
    assert langid.predicted(frame(spark, odd_texts()), model).select("lang_pred").distinct().collect()[0][0] == "und"


def test_document_frequencies_count_every_document(spark):
    frequency, n = langid.document_frequencies(frame(spark, ["ab", "abab", "b", None]))
    [(columns, owner), *_] = list(langid.grams(["ab"]))
    assert n == 4 and sorted(frequency[columns]) == [2, 3]


# --- 3: Jaccard join


def joined(df, **kw):
    return sorted(map(repr, ((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.joined(df, **kw).collect())))


def near_copies(r, base, n, change):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(change):
            w[r.randrange(len(w))] = r.choice(WORDS)
        out.append(" ".join(w))
    return out


def test_jaccard_is_exact(spark):
    r = random.Random(7)
    docs = odd_texts()
    docs += near_copies(r, prose(r, 120), 40, 3) + near_copies(r, prose(r, 60), 12, 2) + near_copies(r, prose(r, 9), 8, 1)
    passage = prose(r, 40)
    docs += [passage + " " + prose(r, r.choice([3, 6, 9, 30])) for _ in range(40)]
    docs += [docs[20].upper(), docs[20], " ".join(docs[21].split()[:118])]
    docs += [prose(r, 50) for _ in range(30)]
    ids = list(range(len(docs)))
    random.Random(1).shuffle(ids)
    ids[5] = ids[6]
    assert joined(frame(spark, docs, EXTRA, ids)) == sorted(map(repr, jaccard.brute_force(list(zip(ids, docs)))))


def test_jaccard_with_hard_classes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT_HARD", 2)  # combinations of two
    monkeypatch.setattr(jaccard, "FAMILY_BLOCK", 8)
    r = random.Random(8)
    docs = near_copies(r, prose(r, 100), 60, 4) + near_copies(r, prose(r, 30), 30, 1) + [prose(r, 20) for _ in range(10)]
    assert joined(frame(spark, docs), buckets=3) == sorted(map(repr, jaccard.brute_force(list(enumerate(docs)))))


def test_jaccard_combines_frequent_tokens(spark):
    """With the parameters of production: a passage that more texts hold than a token that is indexed singly may have."""
    r = random.Random(11)
    passage = prose(r, 12)
    own = lambda n: " ".join(f"w{r.randrange(10**9)}" for _ in range(n))
    docs = [passage + " " + own(2) for _ in range(jaccard.FREQUENT_HARD // 4)] + near_copies(r, prose(r, 60), 12, 1) + [own(20)]
    docs += [passage + " " + own(1), passage + " " + " ".join(docs[0].split()[12:] + ["z"])]
    report = {}
    got = {x.doc_id: x.component_id for x in jaccard.joined(frame(spark, docs), report=report).collect()}
    assert got == {i: c for i, _, c in jaccard.brute_force(list(enumerate(docs)))}
    assert report["combined_hard_keys"] > 0 and report["single_keys"] > 0 and report["hard"] >= jaccard.FREQUENT_HARD // 4


def test_jaccard_of_hot_tokens_and_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PART", 50)
    r = random.Random(12)
    line = prose(r, 8)
    docs = [line + "\n" + prose(r, r.choice([2, 30])) for _ in range(80)] + near_copies(r, line + " " + prose(r, 40), 40, 2) + [line] * 50 + [None, ""] * 20
    assert len(jaccard.hot_tokens(frame(spark, docs))) > 0
    assert joined(frame(spark, docs), buckets=3) == sorted(map(repr, jaccard.brute_force(list(enumerate(docs)))))


def test_jaccard_of_empty_tables(spark):
    assert joined(frame(spark, [])) == []
    assert joined(frame(spark, [None, ""])) == ["(0, 0, 0)", "(1, 0, 1)"]
    kept = jaccard.keep_first(frame(spark, ["a b c", "z", "A b  c", None], EXTRA))
    assert kept.columns == frame(spark, [], EXTRA).columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 3]


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (105, 101)]
    got = {r.node: r.label for r in jaccard.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100, 105: 100}


# --- 4: quality classifier


def labelled(spark, n=400):
    r = random.Random(9)
    docs, labels = [], []
    for k in range(n):
        good = r.random() < 0.8
        docs.append(prose(r, 80) if good else " | ".join(prose(r, 1) for _ in range(60)))
        if k % 10 == 0:
            docs[-1] += " zork" * 40
        labels.append((k, int(good), int(k % 10 == 0)))
    return frame(spark, docs + odd_texts(), EXTRA), spark.createDataFrame(labels + labels[:5], "doc_id long, quality int, toxic int"), docs, labels


def test_quality_by_held_out_accuracy(spark):
    docs, labels, texts, known = labelled(spark)
    model = quality_model.fit(docs, quality_model.learning_labels(labels), rows=250)
    got = {r.doc_id: r for r in quality_model.digest(quality_model.scored(docs, model)).collect()}
    out = [k for k, *_ in known if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out for k in out)
    assert np.mean([got[k].predicted == known[k][1] for k in out]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[len(texts)].score == got[len(texts) + 1].score == pytest.approx(1 / (1 + np.exp(-model.bias)))
    kept = quality_model.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.predicted}


def test_quality_score_is_the_sparse_dot_product(spark):
    docs, labels, texts, _ = labelled(spark, 60)
    model = quality_model.fit(docs, labels)
    from veritrace.llm.common import buffers
    import pyarrow as pa

    columns, first = quality_model.features(*buffers(pa.array(texts)))
    for k in range(5):
        part = columns[:, first[k] : first[k + 1]].ravel()
        i, c = np.unique(part[part < 1 << quality_model.BITS], return_counts=True)
        x = model.bias + (model.weights[i] * c).sum() * quality_model.SCALE / (first[k + 1] - first[k])
        assert model.logits(*buffers(pa.array(texts)))[k] == pytest.approx(x)


def test_quality_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality_model.fit(frame(spark, []), none)
    assert quality_model.scored(frame(spark, []), model).count() == 0
    assert quality_model.scored(frame(spark, ["x"]), model).first().score == 0.5


# --- 5: extraction


def page(k, body, nav=("home", "news", "about")):
    links = "".join(f"<li><a href='/{x}'>{x}</a>" for x in nav)
    return f"""<!DOCTYPE html><html><head><title>t{k}</title><style>p{{x}}</style><script>var a = "</p>";</script></head><body class="x has-sidebar"><nav><ul>{links}</ul></nav>
<div class="cookie-notice">We use cookies {k}</div><div class="ad">buy {k}</div><p>Published by the same house</p><article>{body}</article>
<section id="comments"><p>first {k}!</p></section><form><p>search</p></form><footer>&copy; {k}</footer></body></html>"""


def test_extraction(spark):
    pages, want = [], []
    for k in range(30):
        body = [f"Head {k}", f"A &amp; <b>bold</b>\n  text {k}<br>more", "Shared closing line"]
        pages.append((k, "https://WWW.Example.org/a" if k % 2 else "http://b.example/x", page(k, f"<h1>{body[0]}</h1><p>{body[1]}<p>{body[2]}</p>")))
        want.append("\n\n".join([f"Head {k}", f"A & bold text {k} more", "Shared closing line"]))
    pages += [(50, None, None), (51, "no url", ""), (52, "http://c/", "<p>a<p>b &lt;i&gt; <b>c"), (52, "http://c/", "plain < text"), (53, "http://c/", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, template string")
    got = html_extract.digest(html_extract.extract(df)).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(pages) and [by[k].text for k in range(30)] == want
    assert by[50].text == by[51].text == "" and by[51].n_chars == 0 and by[53].text == "deep"
    assert {r.text for r in got if r.page_id == 52} == {"a\n\nb <i> c", "plain < text"}


def test_extraction_by_salted_join(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", 0)
    df = spark.createDataFrame([(k, "http://h/", page(k, f"<p>t{k}")) for k in range(20)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == {k: f"t{k}" for k in range(20)}


def test_extraction_of_empty_table(spark):
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def induced(pages):
    """Texts of one host's pages, without Spark."""
    own = html_extract.Pattern(tuple(pages[: html_extract.MERGED]))
    seen = [html_extract.observe(p, own) for p in pages]
    nodes = {}
    for k, text, free in (x for s in seen for x in s):
        nodes.setdefault(k, []).append((text, free))
    rows = []
    for k, v in nodes.items():
        top = max({t for t, _ in v}, key=lambda t: sum(x == t for x, _ in v))
        same = sum(x == top for x, _ in v)
        constant = len(v) >= html_extract.LEAST_PAGES and same >= html_extract.CONSTANT_SHARE * len(v)
        rows.append((k, top if constant else None, sum(f for t, f in v if not (constant and t == top))))
    wrapper = html_extract.Wrapper(own, {k: t for k, t, _ in rows if t is not None}, frozenset(own.outside({k: m for k, _, m in rows})))
    return [html_extract.main_text(p, wrapper) for p in pages]


def test_constant_nodes_outside_articles_become_template():
    assert induced([f"<body><div><p>same words</p></div><div><p>own {k}</p></div></body>" for k in range(6)]) == [f"own {k}" for k in range(6)]


def test_the_region_is_where_text_varies():
    r = random.Random(13)
    body = [prose(r, 60) for _ in range(6)]
    pages = [f"<body><div><ul><li><a href=x>{prose(r, 2)}</a></ul></div><h1>t {k}</h1><div><div>{body[k]}</div><div><p>second {body[k - 1][:150]}</div></div><div>{prose(r, 3)}</div></body>" for k in range(6)]
    assert induced(pages) == [f"t {k}\n\n{body[k]}\n\nsecond {body[k - 1][:150].strip()}" for k in range(6)]
    assert all(html_extract.main_text(p) != t for p, t in zip(pages, induced(pages)))  # names alone see no difference


def test_parts_of_other_layouts_have_a_place_in_the_pattern():
    pages = [f"<body><div><p>own {k} {k * 7}</p></div>" + ("<div class=z>standing words</div>" if k % 2 else "<section>other words</section>") + "</body>" for k in range(12)]
    assert induced(pages) == [f"own {k} {k * 7}" for k in range(12)]


def plain_match(x, y):
    """Most pairs of an order-keeping matching, by the textbook recursion."""
    if (x.tag, x.label) != (y.tag, y.label):
        return 0
    a, b = x.children, y.children
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain_match(a[i], b[j]))
    return 1 + best[-1][-1]


def test_matching_has_the_most_pairs(monkeypatch):
    r = random.Random(14)

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1)}</{t}>" for t in r.choices(["div", "ul", "section"], k=r.randint(0, 4))) if depth else ""

    for cells in (html_extract.Matching.CELLS, 2):
        monkeypatch.setattr(html_extract.Matching, "CELLS", cells)
        for _ in range(150):
            a, b = html_extract.parse(tree(3)), html_extract.parse(tree(3))
            pairs = html_extract.match(a, b)
            assert len(pairs) == plain_match(a, b) and len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)
    many = [html_extract.parse("".join(f"<{r.choice(['p', 'div'])}>" + "</div>" * 0 for _ in range(3000))) for _ in range(2)]
    assert html_extract.match(*many)


def varied(n, kinds, seed):
    r = random.Random(seed)
    return "<ul>" + "".join("<li>" + "".join(f"<span class=c{r.randrange(kinds)}>x</span>" for _ in range(3)) + "</li>" for _ in range(n)) + "</ul>"


def test_lists_of_varied_items_match_as_plainly_and_in_seconds():
    a, b = (html_extract.parse(varied(14, 5, seed)) for seed in (1, 2))
    assert len(html_extract.match(a, b)) == plain_match(a, b)
    began = time.perf_counter()
    a, b = (html_extract.parse(varied(4000, 1000, seed)) for seed in (1, 2))
    assert len(html_extract.match(a, b)) > 4000  # every item has a partner, and some spans
    html_extract.merge(a, b)
    assert time.perf_counter() - began < 60


def test_deep_varied_trees_match():
    deep = lambda seed: "".join(f"<div class=d{k % 7}><b class={random.Random(seed * 100_000 + k).choice('abc')}></b>" for k in range(1500))
    a, b = html_extract.parse(deep(1)), html_extract.parse(deep(2))
    assert len(html_extract.match(a, b)) > 1500


def test_broken_pages_take_linear_time():
    began = time.perf_counter()
    for page_ in ('<a "' * 250_000, "<div>" * 150_000 + "</x>" * 150_000, "<a '>' " * 150_000 + "'", "<b>" * 150_000 + "<p></p>" * 100_000, "<ul>" + "<div>" * 100_000 + "<li>" * 100_000):
        html_extract.parse(page_)
    assert time.perf_counter() - began < 60


def test_titles_and_names_within_articles_stay():
    for page_, want in (
        ("<article><header><h1>title</h1></header><p>text</p><footer>no</footer></article>", "title\n\ntext"),
        ('<main><div class="long-form">a</div><p class="share-price">b</p></main>', "a\n\nb"),
        ("<header>no</header><main>text</main>", "text"),
    ):
        assert html_extract.main_text(page_) == want


def test_matching_keeps_order():
    a, b = html_extract.parse("<ul><li>1<li>2<b>x</b></ul><p>z"), html_extract.parse("<div>q</div><ul><li>1<li>2<b>x</b></ul><p>z")
    tags = [(x.tag, y.tag) for x, y in html_extract.match(a, b)]
    assert all(x == y for x, y in tags) and sorted(x for x, _ in tags) == ["#", "b", "li", "li", "p", "ul"]
    assert html_lib.unescape("&amp;") == "&"


def _kept(page: str) -> str:
    out = []

    def walk(node):
        for x in node.parts:
            if isinstance(x, str):
                out.append(x)
            elif not x.skip:
                walk(x)

    walk(html_extract.parse(page))
    return " ".join("".join(out).split())


def test_attributes_drop_no_article_text():
    for mark in ('style="overflow:hidden"', 'aria-hidden="false"', 'title="the hidden house"', "data-hidden=1", 'data-x=\'class="ad"\'', 'aria-label="Comments on Kant"'):
        assert _kept(f"<body><article {mark}><p>text</p></article>") == "text", mark
        assert _kept(f"<body><article><div {mark}>text</div></article>") == "text", mark
    for name in ("related-work", "side-effects", "legal-history", "social-life", "comments-on-kant", "entry-header", "search-trees"):
        for page in (f'<article><section id="{name}">text</section></article>', f'<main><div class="{name}">text</div></main>', f'<div><h2 id="{name}">text</h2></div>'):
            assert _kept(page) == "text", page
    assert _kept('<article><h2 id="search">text</h2></article>') == "text"
    for mark in ("hidden", "hidden=''", 'HIDDEN class="x"', 'aria-hidden="true"', 'class="x ad"', 'class="comments"', 'id="disqus_thread"', 'class="related-posts"', 'role="navigation"', 'class="cookie-notice"'):
        assert _kept(f"<article>text<div {mark}>no</div></article>") == "text", mark
    assert _kept("<article hidden>no</article>") == ""
    for name in ("reader-comments", "user-comments", "ad-banner", "promo-box", "site-notice", "ad_slot_2", "comments-wrapper"):
        for kind in ("class", "id"):
            assert _kept(f"<article>text<div {kind}={name}>no</div></article>") == "text", name
    for name in ("side-effects", "social-history", "search-algorithm", "section-header", "entry-header", "legal-history", "related-work", "notice-board", "post-header"):
        assert _kept(f"<body><div class={name}><p>text</p></div></body>") == "text", name
        assert _kept(f"<article><div class={name}><p>text</p></div></article>") == "text", name
    for name in ("site-header", "page-header", "header", "side", "share-bar", "related-posts", "search-form", "notice", "main-nav", "left-sidebar"):
        assert _kept(f"<body><div class={name}><p>no</p></div><p>text</p></body>") == "text", name


def test_long_texts_are_cut_without_a_difference(monkeypatch):
    import numpy as np

    from veritrace.llm import langid

    texts = ["Ein kurzer Text.", "", "ΑΣ ΣΑΣ é" * 40, "x", "ab" * 33]

    def plain(text):  # each n-gram by itself
        out = {}
        low = text.lower()
        for n in langid.ORDERS:
            for at in range(len(low) - n + 1):
                h = np.uint32(n)
                for k, c in enumerate(low[at : at + n]):
                    h = np.uint32((int(h ^ np.uint32(ord(c))) * int(langid._FACTOR[k % 3])) & 0xFFFFFFFF)
                    h ^= h >> np.uint32(15)
                column = int(h) >> (32 - langid.BITS)
                out[column] = out.get(column, 0) + 1
        return out

    r = np.random.default_rng(4)
    model = langid.Model(["a", "b"], r.random((1 << langid.BITS, 3)).astype(np.float32), r.random(2), 1.0)
    whole = model.logits(texts)
    for size in (1 << 18, 1, 2, 3, 7, 50):
        monkeypatch.setattr(langid, "CHUNK", size)
        for t in texts:
            assert dict(zip(*(x.tolist() for x in langid.counts(t)))) == plain(t), size
        assert np.allclose(model.logits(texts), whole, rtol=1e-5)


# --- 6: token counts


def test_prefix_counts_are_the_librarys(spark):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(token_prefix.tokenizer_path())
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    r = random.Random(2)
    parts = ["a", " ", "  ", "\n", "'s", "'re", "'", "hello", "日本", "é", " ", "12", "!", "<|endoftext|>", "<|", "\t", "the", " '", "👍", "\x85", "\x1c", "½", "_"]
    for _ in range(150):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 10)))
        assert token_prefix.prefix_counts(t).tolist() == [count(t[:k]) for k in range(len(t) + 1)], repr(t)
    docs = odd_texts() + ["x" * 3000, "ab " * 2000]
    for row in token_prefix.digest(token_prefix.token_counts(frame(spark, docs, EXTRA))).collect():
        t = docs[row.doc_id] or ""
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(t.encode()), count(t), count(t) > 1024)
        assert count(t[: row.limit_chars]) <= 1024 and (row.limit_chars == len(t) or count(t[: row.limit_chars + 1]) > 1024)


def test_very_long_units_take_linear_time():
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(token_prefix.tokenizer_path())
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    for t in (" " * 20_000 + "x", "\n" * 20_000 + "'re", "a" * 20_000, "=" * 20_000, " \n" * 10_000 + "12", "\t" * 5000 + "'s", "  're", "\n\n'll x", "\n 've"):
        assert token_prefix.counter().text_steps(t).sum(dtype=np.int64) == count(t), t[-9:]
    began = time.perf_counter()
    for c in " \n":
        assert token_prefix.counter().text_steps(c * 1_000_000).sum(dtype=np.int64) > 0
    assert time.perf_counter() - began < 60


def test_stored_steps_answer_budgets(spark):
    text = odd_texts()[7][:2000]
    row = token_prefix.token_counts(frame(spark, [text]), keep_steps=True).first()
    counts = token_prefix.prefix_counts(text)
    for k in (0, 1, 57, 1999, 2000):
        assert token_prefix.tokens_upto(row.steps, k) == counts[k]
    chars = token_prefix.tokens_within(row.steps, 100)
    assert counts[chars] <= 100 < counts[chars + 1 :].min()
    assert token_prefix.token_counts(frame(spark, [])).count() == 0


# --- 7: mixing


def test_mixing_meets_the_targets(spark):
    docs, labels, texts, _ = labelled(spark)
    model = mixing.fit_posteriors(docs, labels, rows=300)
    held = mixing.posteriors(docs, model).cache()
    weights = [1.0 + k for k in range(len(model.domains))]
    fit = mixing.fit_rates(held, weights, 0.4)
    p = np.array([r.p for r in held.collect()])
    n = np.array([r.n_tokens for r in held.collect()])
    rates = mixing.rates(p, n, fit.start, fit.steps)
    assert (rates >= 0).all()
    # a plain solver of the same least squares cannot come closer
    want = np.array(fit.targets)
    got = (rates * n) @ p
    scale = 1 / np.maximum(n @ p, 1e-9)
    plain = np.full(len(n), 0.4)
    for _ in range(3000):
        plain = np.maximum(0, plain + p @ ((want - (plain * n) @ p) * scale))
    loss = lambda x: float((scale * (x - want) ** 2).sum())
    assert loss(got) <= 1.05 * loss((plain * n) @ p) + 1e-3 * loss((n * 0.4) @ p)
    assert fit.totals == pytest.approx(got.tolist())
    held.unpersist()


def test_mixing_rows_and_empty_tables(spark):
    docs, labels, *_ = labelled(spark, 120)
    out = mixing.mixed(docs, labels).collect()
    assert len(out) == docs.count() and all(r.rate >= 0 and abs(r.copies - r.rate) <= 1 for r in out)
    assert [r.rate for r in out if r.n_tokens == 0][0] == mixing.TOTAL_SHARE
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.mixed(frame(spark, []), labels).count() == 0
    assert mixing.mixed(frame(spark, ["a b"]), none).count() == 1


# --- 8: quality rules


def plain_measures(text):
    t = text or ""
    w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
    windows = {}
    for k in range(len(w) - 4):
        windows.setdefault(tuple(w[k : k + 5]), []).append(k)
    covered = {q for at in windows.values() if len(at) > 1 for k in at for q in range(k, k + 5)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_are_exact(spark):
    r = random.Random(4)
    docs = odd_texts() + ["a b c d e a b c d e f", "a a a a a a a", "x\ny\nx\n \n \nx", prose(r, 30) + "\n" + prose(r, 30)] * 2
    docs += [" ".join(r.choice("ab") for _ in range(r.randint(3, 30))) for _ in range(60)]
    got = quality_rules.measured(frame(spark, docs, EXTRA)).collect()
    for row in got:
        n, chars, symbols, dup, rep = plain_measures(docs[row.doc_id])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (n, chars, symbols, dup, rep), docs[row.doc_id]
        assert row.base_failed == (n < 10 or 100 * rep > 20 * n) and not (row.base_failed and row.kept)


def test_the_cascades_order_changes_no_verdict(spark):
    docs = frame(spark, odd_texts() + ["# | # | # |" * 9, "clean words of a common kind that say something new here today"], EXTRA)
    kept = lambda order: {r.doc_id for r in docs.where(quality_rules.rejected_by(docs.text, order).isNull()).collect()}
    one = kept(quality_rules.RULES)
    assert one == kept(quality_rules.RULES[::-1]) == {r.doc_id for r in quality_rules.keep_good(docs).collect()} == {r.doc_id for r in quality_rules.measured(docs).where("kept").collect()}
    assert len(odd_texts()) + 1 in one
    costs = quality_rules.estimate(quality_rules.measures(docs), lambda rule: rule.fails(quality_rules.Measures.at_hand()), quality_rules.F.col("n_symbols") < 0)
    assert len(costs) == len(quality_rules.RULES) and all(e.seconds > 0 and 0 <= e.rejected <= 1 and len(e.rejects) == docs.count() for e in costs)
    assert quality_rules.measured(frame(spark, [])).count() == 0


def test_the_order_is_by_conditional_rejection_per_cost():
    rule = lambda n: quality_rules.Rule(n, None)
    a = quality_rules.Estimate(rule("a"), 1.0, (True, True, True, False))
    b = quality_rules.Estimate(rule("b"), 1.0, (True, True, False, False))  # nothing that a leaves
    c = quality_rules.Estimate(rule("c"), 2.0, (False, False, False, True))
    assert [r.name for r in quality_rules.ordered([b, c, a])] == ["a", "c", "b"]
    assert quality_rules.ordered([]) == [] and [r.name for r in quality_rules.ordered([quality_rules.Estimate(rule("x"), 1, ())])] == ["x"]


# --- 9: language model


def test_gradient_is_the_derivative():
    r = np.random.default_rng(0)
    net = masked_lm.Network()
    context, target = r.integers(0, masked_lm.VOCABULARY + 1, (40, 4)), r.integers(0, masked_lm.VOCABULARY, 40)
    g = net.gradient(context, target).vector
    loss = lambda v: -masked_lm.Network(v).log_p(context, target).astype(float).mean()
    for k in np.argsort(-np.abs(g))[:: 400][:12]:
        up, down = net.vector.astype(np.float32).copy(), net.vector.copy()
        up[k] += 0.02
        down[k] -= 0.02
        assert (loss(up) - loss(down)) / 0.04 == pytest.approx(g[k], rel=0.1, abs=2e-4)


def test_probabilities_sum_to_one():
    net, context = masked_lm.Network(), np.array([[1, 2, 3, masked_lm.PAD]])
    total = sum(np.exp(net.log_p(np.repeat(context, 512, 0), np.arange(at, at + 512))).sum() for at in range(0, masked_lm.VOCABULARY, 512))
    assert total == pytest.approx(1, abs=1e-3)


def test_scores_tell_order_from_noise(spark):
    r = random.Random(6)
    follow = {w: r.sample(WORDS, 2) for w in WORDS}

    def chain(n):
        out = [r.choice(WORDS)]
        while len(out) < n:
            out.append(r.choice(follow[out[-1]]))
        return " ".join(out)

    docs = [chain(200) for _ in range(150)]
    mixed_up = []
    for t in docs[:30]:
        w = t.split()
        r.shuffle(w)
        mixed_up.append(" ".join(w))
    df = frame(spark, docs, EXTRA)
    words = masked_lm.vocabulary(df)
    net = masked_lm.fit(df, words, rounds=3, share=1.0)
    score = lambda d: {x.doc_id: x for x in masked_lm.digest(masked_lm.scored(d, words, net)).collect()}
    right, wrong, odd = score(df), score(frame(spark, mixed_up)), score(frame(spark, odd_texts()))
    assert np.mean([right[k].log_likelihood > wrong[k].log_likelihood for k in range(30)]) > 0.9
    assert odd[0].n_words == 0 and odd[0].log_likelihood == 0 and odd[0].mean_log_p is None
    # one text's score does not depend on its neighbours in a batch
    alone = score(frame(spark, [docs[4]]))[0]
    assert alone.log_likelihood == pytest.approx(right[4].log_likelihood, rel=1e-5)


def test_lm_learns_from_every_document_by_default(spark):
    # without a share or rounds given; of a single document too
    for docs in (["x y z w v"], [f"x{k} y{k} z{k}" for k in range(12)]):
        df = frame(spark, [" ".join([t] * 60) for t in docs])
        words = masked_lm.vocabulary(df)
        mean = lambda net: [x.mean_log_p for x in masked_lm.digest(masked_lm.scored(df, words, net)).collect()]  # noqa: E731, B023
        assert all(a > b + 1 for a, b in zip(mean(masked_lm.fit(df, words)), mean(masked_lm.Network())))
    r = random.Random(8)
    follow = {w: r.sample(WORDS, 2) for w in WORDS}
    docs = []
    for _ in range(100):
        out = [r.choice(WORDS)]
        while len(out) < 400:
            out.append(r.choice(follow[out[-1]]))
        docs.append(out)
    df = frame(spark, [" ".join(t) for t in docs])
    words = masked_lm.vocabulary(df)
    net = masked_lm.fit(df, words)
    score = lambda ts: [x.log_likelihood for x in masked_lm.scored(frame(spark, [" ".join(t) for t in ts]), words, net).orderBy("doc_id").collect()]
    assert np.mean([a > b for a, b in zip(score(docs[:30]), score([r.sample(t, len(t)) for t in docs[:30]]))]) > 0.9


def test_lm_of_empty_tables(spark):
    words = masked_lm.vocabulary(frame(spark, []))
    net = masked_lm.fit(frame(spark, []), words)
    assert masked_lm.scored(frame(spark, []), words, net).count() == 0
    assert masked_lm.scored(frame(spark, ["a b"]), words, net).first().log_likelihood < 0


def test_lm_scores_written_words_as_it_scores_texts(spark):
    df = frame(spark, [*odd_texts(), *[" ".join(WORDS[k : k + 9] * 40) for k in range(6)], None])
    vocab = masked_lm.vocabulary(df)
    words = masked_lm.encoded(df, vocab)
    net = masked_lm.learned(words)
    assert np.allclose(net.vector, masked_lm.fit(df, vocab).vector, atol=1e-6)
    rows = lambda scores: [(x.doc_id, x.n_words, pytest.approx(x.log_likelihood, rel=1e-5)) for x in scores.orderBy("doc_id").collect()]
    found = masked_lm.scored_words(words, net)
    assert [tuple(x) for x in found.orderBy("doc_id").collect()] == rows(masked_lm.scored(df, vocab, net))


def test_lm_long_spans_come_in_parts(monkeypatch):
    r = np.random.default_rng(9)
    net = masked_lm.Network()
    context, target = r.integers(0, masked_lm.VOCABULARY + 1, (500, 4)).astype(np.uint16), r.integers(0, 3 * masked_lm.WIDTH, 500).astype(np.uint16)
    whole, scores = net.gradient(context, target).vector, net.log_p(context, target)
    monkeypatch.setattr(masked_lm, "GROUP_ROWS", 48)
    groups = masked_lm._groups([(0, 0, 200), (1, 200, 210), (2, 210, 500)])
    assert all(j - i <= 48 for i, j, _ in groups) and [k for i, j, _ in groups for k in range(i, j)] == list(range(500))
    assert np.allclose(net.gradient(context, target).vector, whole, atol=1e-7) and np.allclose(net.log_p(context, target), scores, atol=1e-5)


def test_lm_pass_is_plain_adagrad():
    r = np.random.default_rng(10)
    context, target = r.integers(0, 300, (600, 4)), r.integers(0, 300, 600)
    plain, seen = masked_lm.Network().vector.copy(), np.full(masked_lm.Network.SIZE, 1e-6, np.float32)
    order, rate = np.random.default_rng(3).permutation(600), 0.2 * (200 / masked_lm.STEP_WORDS[0]) ** 0.5
    for at in range(0, 600, 200):
        rows = order[at : at + 200]
        g = masked_lm.Network(plain).gradient(context[rows], target[rows]).vector
        seen += g * g
        plain = (plain - rate * g / np.sqrt(seen)).astype(np.float32)
    assert np.allclose(masked_lm.train(masked_lm.Network(), context, target, batch=200).vector, plain, atol=2e-3)


def test_lm_counts_words_over_many_slices(spark, monkeypatch):
    r = random.Random(12)
    texts = [" ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(60)) for _ in range(80)]
    monkeypatch.setattr(masked_lm, "slices", lambda b, text: (b.slice(k, 3) for k in range(0, b.num_rows, 3)))
    found = sorted(x.n for x in masked_lm.word_counts(frame(spark, [*texts, None, ""]).coalesce(1)).collect())
    assert found == sorted(Counter(w for t in texts for w in t.split()).values())


# --- 10: licences


def licence_texts(*names, holder="the copyright holder"):
    return [x.replace("*", holder).replace("{}", "3") for n in names for x in licenses._TEXTS[n][:1 if n == "GPL-FREE" else None]]


def test_licences(spark):
    mit = " ".join(licenses._TEXTS["MIT"])
    bsd = "\n".join(licence_texts("BSD-HEAD", "BSD-SOURCE", "BSD-BINARY"))
    apache = """Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n
Unless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License."""
    docs = [
        "words. Released under the MIT License. more", "Licensed under the Apache License, Version 2.0.", "x\nThis work is licensed under the GNU General Public License, version 3.\ny",
        "Licensed under CC BY-NC 4.0.", mit.upper(), bsd, bsd + "\n" + "\n".join(licence_texts("BSD-NAME")), "SPDX-License-Identifier: MIT", "a licence to kill", None, "", mit + "\n" + mit,
        licenses._TEXTS["GPL-FREE"][0].format(2), apache, bsd + "\n" + "\n".join(licence_texts("BSD-NAME", "BSD-AS-IS", "BSD-LIABLE", holder="Foo Bar Inc")), "The code is MIT licensed.", "\n".join(licence_texts("GPL-FREE", "GPL-HOPE", "GPL-SEE", holder="program")),
        "\n".join(licence_texts("MPL-FORM", "MPL-COPY")), "Foo is free software; " + licenses._TEXTS["LGPL-FREE"][0].format("2.1").split("; ", 1)[1],
    ]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, docs, EXTRA)).collect()}
    want = [["MIT"], ["Apache-2.0"], ["GPL-3.0"], ["CC-BY-NC-4.0"], ["MIT"], ["BSD-2-Clause"], ["BSD-3-Clause"], ["MIT"], [], [], [], ["MIT", "MIT"], ["GPL-2.0"], ["Apache-2.0"], ["BSD-3-Clause"], ["MIT"], ["GPL-3.0"], ["MPL-2.0"], ["LGPL-2.1"]]
    assert [got[k].licences for k in range(len(docs))] == want
    assert [len(got[k].sentences) for k in (13, 14, 16)] == [5, 6, 3]  # of rules of so many sentences
    assert licenses.digest(licenses.scan(frame(spark, docs))).where("n_matches > 0").count() == 16
    assert licenses.scan(frame(spark, [])).count() == 0


def plain_matched(found, rules):
    """The same by trying every choice of places in order."""
    free, out = dict(found), []
    for rule in rules.rules:
        for start, _ in found:
            if free.get(start) != rule.sequence[0]:
                continue
            used = [start]
            for name in rule.sequence[1:]:
                used += [k for k in range(used[-1] + 1, used[-1] + 2 + licenses.GAP) if free.get(k) == name][:1] or [None]
                if used[-1] is None:
                    break
            if None not in used:
                out.append((start, rule.licence))
                for k in used:
                    del free[k]
    return sorted(out)


def test_rules_match_as_the_plain_matcher_does():
    rules, r = licenses.default_rules(), random.Random(15)
    names = sorted({n for rule in rules.rules for n in rule.sequence if not n.endswith("notice")})
    for _ in range(300):
        places = sorted(r.sample(range(60), 25))
        found = [(k, r.choice(names[: r.randint(3, len(names))])) for k in places]
        assert licenses.matched(found, rules) == plain_matched(found, rules)
    began = time.perf_counter()
    text = "Released under the MIT License.\n" * 40_000
    assert len(licenses.matched(licenses.recognised(text, rules), rules)) == 40_000
    assert time.perf_counter() - began < 30


def test_wrapped_licences_are_recognised():
    rules = licenses.default_rules()
    scan = lambda t: [x for _, x in licenses.matched(licenses.recognised(t, rules), rules)]
    mit, isc, gpl = licenses._TEXTS["MIT"], licenses._TEXTS["ISC"], [licenses._TEXTS["GPL-FREE"][0].format(3)]
    bsd = licence_texts("BSD-HEAD", "BSD-SOURCE", "BSD-BINARY", "BSD-NAME", "BSD-AS-IS", "BSD-LIABLE", holder="Foo")
    for texts, want in ((mit, "MIT"), (isc, "ISC"), (gpl, "GPL-3.0"), (bsd, "BSD-3-Clause")):
        for width in (25, 72):
            for mark in ("", " * ", "# "):
                lines = [f"{mark}{x}" for t in texts for x in [*textwrap.wrap(t, width), ""]]
                assert scan("\n".join(["/*", f"{mark}Copyright (c) 2020 A. B.", mark, *lines, "*/ code"])) == [want]
    assert scan("words. Released  under\nthe  MIT License. more") == ["MIT"]
    assert scan("Permission is hereby granted,\nto no one.") == []


def test_a_gap_too_wide_breaks_a_sequence():
    rules = licenses.default_rules()
    near, far = [(0, "MIT/1"), (4, "MIT/2")], [(0, "BSD-HEAD/1"), (9, "BSD-SOURCE/1"), (10, "BSD-BINARY/1")]
    assert licenses.matched(near, rules) == [(0, "MIT")] and licenses.matched(far, rules) == []


def test_lean_changes_no_result():
    from veritrace.llm.common import lean

    big = pa.table({"x": pa.array(range(1 << 18), pa.int64())})

    def doubled(batches):
        for b in batches:
            yield b * 2

    assert list(lean(doubled)(iter([1, 2]))) == [2, 4]
    for t in (big, big[:0]):
        assert lean(lambda t: t)(t).equals(t)
        assert lean(lambda a, b: pa.concat_tables([a, b]))(t, big).num_rows == t.num_rows + big.num_rows


def test_language_model_steps_reuse_arrays_and_match_plain_ones(monkeypatch):
    r = np.random.default_rng(4)
    net = masked_lm.Network(r.normal(0, 0.3, masked_lm.Network.SIZE).astype(np.float32))
    context, target = r.integers(0, masked_lm.VOCABULARY + 1, (700, 4)).astype(np.uint16), r.integers(0, masked_lm.VOCABULARY, 700).astype(np.uint16)
    h = np.tanh(sum(net.embed[p][context[:, p]] for p in range(4)) + net.hidden).astype(float)
    cls, place = target // masked_lm.WIDTH, target % masked_lm.WIDTH
    one, two = h @ net.cls + net.cls_bias, np.einsum("nh,nhw->nw", h, net.word[cls]) + net.word_bias[cls]
    plain = sum(x[np.arange(700), k] - np.log(np.exp(x).sum(1)) for x, k in ((one, cls), (two, place)))
    whole = net.gradient(context, target).vector
    work = masked_lm.Work(1000)
    for rows, small in ((64, 30), (1 << 12, 30), (64, 0)):  # groups of few rows, of all; by each row's maximum
        monkeypatch.setattr(masked_lm, "GROUP_ROWS", rows)
        monkeypatch.setattr(masked_lm, "SMALL", small)
        for _ in range(2):
            assert np.allclose(net.log_p(context, target, work), plain, atol=1e-4)
            g = masked_lm.Network(np.zeros(net.SIZE, np.float32))
            net.gradient_into(g, context, target, work)
            assert np.allclose(g.vector, whole, atol=1e-7)
    large = masked_lm.Network(net.vector * 400)
    assert np.isfinite(large.log_p(context, target)).all() and np.isfinite(large.gradient(context, target).vector).all()


def test_vocabulary_finds_each_known_hash():
    r = np.random.default_rng(5)
    near = (np.uint64(77) << np.uint64(50)) + np.arange(40, dtype=np.uint64)  # one value of the first bits
    known = r.permutation(np.unique(np.concatenate([near, r.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2), np.array([0, (1 << 64) - 1], np.uint64)])))
    words = masked_lm.Vocabulary(known.view(np.int64).tolist())
    assert words.of(known).tolist() == list(range(len(known)))
    other = r.integers(0, 1 << 63, 2000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    other = np.concatenate([other, near + np.uint64(40), near[:1] - np.uint64(1)])
    assert (words.of(other) == masked_lm.VOCABULARY - masked_lm.WIDTH + (other >> np.uint64(58)).astype(np.int64)).all()
    assert len(masked_lm.Vocabulary([]).of(known)) == len(known)
