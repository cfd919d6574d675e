import io
import random
import zlib

import pytest

from auditspark.llm import html_text, language, mixture, warc
from prose import prose


def test_main_text_leaves_out_everything_around_the_article(spark):
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
      <header><a href=/>Site</a></header><nav><ul><li><a href=/a>A</a></li></ul></nav><div class="cookie-notice">We use cookies on this site.</div>
      <div class="ad">Buy many things now and never stop.</div><article><h1>Title  &lt;one&gt;</h1><p><b>First&nbsp;line<br>goes on<p>Sec<i>ond</i> &eacute;&#33;</p><p>No.</p>
      <!-- note --><ul><li>x<li>y</ul></article><aside>Other pieces to read in the evening.</aside><form><p>Your name and your address please.</p><input><button>Send</button></form>
      <section class="comments"><article><p>I liked this piece a lot, more than any other one.</p></article></section><footer>&copy; Site</footer></body></html>"""
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<p>only"), (4, "u", "<nav>x</nav>"), (5, "u", "a < b"), (5, "u", "a < b"),
            (6, "u", "<article>" + "<p>word word</p>" * 20_000 + "</article>")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    found = html_text.extract(pages, html_text.train()).collect()
    texts = {r["page_id"]: r["text"] for r in found}
    assert texts[1] == "Title <one>\n\nFirst line goes on\n\nSecond é!\n\nNo.\n\nx\n\ny"
    assert texts[2] == texts[3] == texts[4] == "" and texts[None] == "only" and texts[5] == "a < b" and len(found) == 8
    assert texts[6].count("word word") == 20_000 and all(r["n_chars"] == len(r["text"]) for r in found)
    assert html_text.extract(pages.limit(0), html_text.train()).count() == 0


def test_tree_fits_its_samples():
    tree = html_text.train()
    for page in html_text.SAMPLES:
        found = html_text.blocks(page)
        kept = html_text.classify(tree, html_text.features(found))
        assert [int(k) for k, b in zip(kept, found) if b.label is not None] == [b.label for b in found if b.label is not None]
    assert html_text.grow(html_text.features([]), html_text.features([])[:, 0]) == 1


def test_any_ranges_give_each_record_once():
    draw = random.Random(2)
    payloads = [draw.randbytes(draw.randrange(0, 3000)) for _ in range(40)]
    payloads[7] = b"\x1f\x8b\x08" * 50
    data = b"junk" + b"".join(warc.record(i, f"http://x/{i}", p) for i, p in enumerate(payloads)) + warc.record(99, "u", b"cut off")[:-9]
    for split in (1, 700, 5000, len(data)) if len(data) < 200_000 else (700, 5000, len(data)):
        step = max(split, 97)
        found = [r for k in range(0, len(data), step) for r in warc.records_of(io.BytesIO(data), k, k + step)]
        assert [f["WARC-Record-ID"] for f, _ in found] == [f"<urn:page:{i}>" for i in range(40)]
        assert [b.partition(b"\r\n\r\n")[2] for _, b in found] == payloads


def test_archives_round_trip(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}</p>" * (i % 5)) for i in range(60)] + [(None, None, "<p>é\r\n\r\n</p>"), (100, "a\r\nb", None), (101, "u", None), (101, "u", None), (102, "u", "x" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload_digest string")
    found = warc.round_trip(pages).collect()
    first = {}
    for i, _, h in rows:
        first[h or ""] = max(first.get(h or "", -1), -1 if i is None else i)
    want = sorted(((i is None, i), len((h or "").encode()), warc.digest((h or "").encode()), "response" if (-1 if i is None else i) == first[h or ""] else "revisit",
                   None if (-1 if i is None else i) == first[h or ""] else first[h or ""]) for i, _, h in rows)
    assert sorted(((r["page_id"] is None, r["page_id"]), *r[1:]) for r in found) == want
    archives = warc.write(pages)
    whole = {r["record_id"]: r for r in warc.read(archives, split=5_000).collect() if r["record_type"] == "response"}
    assert whole["<urn:page:102>"]["payload"] == b"x" * 3_000_000 and whole["<urn:page:null>"]["payload"] == "<p>é\r\n\r\n</p>".encode()
    assert whole["<urn:page:null>"]["target_uri"] is None and warc.read(archives, split=5_000).count() == len(rows)
    assert warc.round_trip(pages.limit(0)).count() == 0


def _tongue(seed, n, endings):
    draw = random.Random(seed)
    return " ".join(draw.choice("ka lo mi re tu sa ven dor".split()) + draw.choice(endings) for _ in range(n))


def test_language_of_the_held_out_fold(spark, docs, odd):
    endings = {"xa": ["ssu", "nno"], "yb": ["éti", "ôli"], "zc": ["ung", "keit"]}
    rows = [(i, _tongue(i, 30 + i % 40, e), lang) for lang, e in endings.items() for i in range({"xa": 0, "yb": 100, "zc": 200}[lang], {"xa": 60, "yb": 160, "zc": 260}[lang])]
    documents = docs(rows + [(900, "kassu", None), (901, "123 456 !?", "xa"), (902, None, "xa")])
    model = language.train(documents)
    found = {r["doc_id"]: r for r in language.predicted(documents, model).collect()}
    assert all(found[i]["lang_pred"] == lang and 0 <= found[i]["score"] <= 1 for i, _, lang in rows)
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert found[900]["lang_pred"] == "xa" and all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (901, 902))
    odd_found = language.predicted(odd, model).collect()
    assert len(odd_found) == 9 and {r["lang_pred"] for r in odd_found if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert language.train(documents.limit(0)) is None and {r["lang_pred"] for r in language.predicted(odd, None).collect()} == {"und"}
    assert language.predicted(documents.limit(0), model).count() == 0


@pytest.mark.parametrize("buckets", [4096, 1])
def test_mixture_meets_targets_and_limits(spark, docs, monkeypatch, buckets):
    monkeypatch.setattr(mixture, "BUCKETS", buckets)
    draw = random.Random(6)
    rows = [(i, "w " * draw.randint(0, 60), "en", draw.choice(["a", "a", "a", "b", "c", None])) for i in range(600)] + [(700, "w w w", "en", "tiny"), (701, None, "en", "void"), (5, "w " * 9, "en", "a")] * 2
    documents = docs(rows)
    one, two = (sorted(map(tuple, mixture.shares(documents).collect())) for _ in range(2))
    assert one == two and len(one) == len(rows)
    size = {}
    for _, text, _, source in rows:
        size[source] = size.get(source, 0) + len((text or "").split())
    names = sorted(s for s in size if s is not None) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(size.values()))
    while True:
        level = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if level[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
            open_.discard(s)
    target |= level
    found = spark.createDataFrame(one, "doc_id long, size long, source_size long, target double, taken long").collect()
    taken = dict.fromkeys(names, 0)
    of = {}
    for d, t, _, s in rows:
        of[d, len((t or "").split())] = s
    for r in found:
        s = of[r["doc_id"], r["size"]]
        assert r["source_size"] == size[s] and abs(r["target"] - target[s]) < 1e-6 * max(1, target[s])
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 31 for s in names)
    mixed = mixture.mixed(documents).collect()
    assert sum(r["taken"] for r in mixed) == sum(taken.values()) and all(r["copies"] > 0 for r in mixed)


def test_a_document_whose_chance_is_exactly_one(docs):
    """Its words are taken off what is open: 4 + 100 * 1 words to a target of 133, 295 words in the other source."""
    rows = [(0, "w w w w", "en", "a")] + [(i, "w", "en", "a") for i in range(1, 101)] + [(200 + i, "w " * 5, "en", "b") for i in range(59)]
    found = mixture.shares(docs(rows)).collect()
    assert {r["target"] for r in found if r["doc_id"] < 200} == {133.0} and sum(r["taken"] for r in found if r["doc_id"] < 200) == 133


def test_mixture_of_odd_and_empty_tables(spark, odd):
    found = mixture.shares(odd).collect()
    assert len(found) == 9 and sum(r["size"] == 0 and r["taken"] == 0 for r in found) == 3
    made = mixture.mixed(odd)
    assert made.columns == [c for c in odd.columns if c not in ("copies", "target")] + ["copies", "taken", "target"] and made.count() <= 6
    assert mixture.shares(odd.limit(0)).count() == 0 == mixture.mixed(odd.limit(0)).count()
    nothing = odd.where("doc_id IN (1, 2, 3)")
    assert {r["taken"] for r in mixture.shares(nothing).collect()} == {0}


def _made_page(draw, bare):
    """A page and the text of its article; without names and with no tag but div if ``bare``."""
    put = lambda name, text: f"<div>{text}</div>" if bare else f"<{name}>{text}</{name.split()[0]}>"
    link = lambda: f"<a href=/x>{prose(draw.randrange(10**6), draw.randint(1, 4))}</a>"
    line = lambda low, high: prose(draw.randrange(10**6), draw.randint(low, high)).replace("\n", " ")
    text = [line(3, 12)] + [line(24, 90) if n == 4 else line(1, 90) for n in range(5)]
    menu = "".join(put("li", link()) for _ in range(draw.randint(3, 8)))
    advert, foot = put('div class="x1"', line(4, 14)), put('div class="x2"', line(4, 14))
    return menu + advert + put("h1", text[0]) + "".join(put("p", t) for t in text[1:]) + foot, "\n\n".join(text)


@pytest.mark.parametrize("bare", [False, True])
def test_main_text_without_names(spark, bare):
    """Menus, adverts and feet go by words and links alone."""
    draw = random.Random(9)
    made = [_made_page(draw, bare) for _ in range(200)]
    found = html_text.extract(spark.createDataFrame([(i, "u", page) for i, (page, _) in enumerate(made)], "page_id long, url string, html string"), html_text.train()).collect()
    assert {r["page_id"]: r["text"] for r in found} == {i: text for i, (_, text) in enumerate(made)}


def test_words_and_links_decide():
    """With constant words and densities the tree cannot tell menus, adverts and feet from the text."""
    draw, tree = random.Random(10), html_text.train()
    for bare in (False, True):
        rows = html_text.features(html_text.blocks(_made_page(draw, bare)[0]))
        level = rows.copy()
        level[:, :6] = 1
        assert 0 < html_text.classify(tree, rows).sum() < len(rows) and (html_text.classify(tree, rows) != html_text.classify(tree, level)).any()


def _plain_end(page, at):
    """Where a tag ends whose name ends at ``at``, sign by sign."""
    quote = None
    for i in range(at, len(page)):
        if quote:
            quote = None if page[i] == quote else quote
        elif page[i] in "\"'":
            quote = page[i]
        elif page[i] == ">":
            return i + 1
    return -1


def test_tags_end_where_a_plain_scan_says():
    draw = random.Random(11)
    for _ in range(300):
        page = "".join(draw.choices("<a>\"' /x", k=draw.randint(0, 60)))
        tags = html_text._Tags(page)
        places = list(range(len(page) + 1))
        draw.shuffle(places)
        assert [tags.end(p) for p in places] == [_plain_end(page, p) for p in places]


@pytest.mark.parametrize("broken", ['<a "', "<a<a", "<a '\"><b \">\"", "<!--", "<div>", "<p <"])
def test_broken_markup_of_a_megabyte_takes_seconds(broken):
    import time

    start = time.perf_counter()
    html_text.blocks(broken * (1_000_000 // len(broken)))
    assert time.perf_counter() - start < 20


def test_a_large_member_is_read_in_time_in_proportion():
    import time

    draw, took = random.Random(12), []
    for size in (8_000_000, 64_000_000):
        data = b"x" * 1000 + warc.record(1, "http://x/1", draw.randbytes(size)) + warc.record(2, "http://x/2", b"end")
        start = time.perf_counter()
        found = [len(block) for _, block in warc.records_of(io.BytesIO(data), 0, len(data))]
        took.append(time.perf_counter() - start)
        assert len(found) == 2 and found[0] > size
    assert took[1] < 30 * max(took[0], 0.05)
