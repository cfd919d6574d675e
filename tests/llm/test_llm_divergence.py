import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from auditspark.llm import divergence
from prose import prose


def plain(rows, top=divergence.TOP_TERMS):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source, text = lang or "", source or "", text or ""
        low = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text)
        terms = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    kept = {lang: sorted(t for t, n in c.items() if n >= divergence.MIN_DOCUMENTS) for lang, c in docs.items()}

    def shares(lang, count):
        terms = kept[lang]
        total = sum(count[t] for t in terms) + 5 * len(terms)
        return {t: 1 + 10**9 * (count[t] + 5) // total for t in terms}

    out = []
    for lang, source in counts:
        whole = Counter()
        for (other, _), count in counts.items():
            if other == lang:
                whole.update(count)
        p, q = shares(lang, counts[lang, source]), shares(lang, whole)
        far = []
        for other, peer in counts:
            if other == lang and peer != source:
                r = shares(lang, counts[lang, peer])
                far.append((-sum(abs(p[t] - r[t]) for t in kept[lang]), peer.encode()))
        over = [(q[t] - p[t], t.encode()) for t in kept[lang] if counts[lang, source][t] and p[t] > q[t]]
        out += [(lang, source, "pair", k.decode(), -v, n + 1) for n, (v, k) in enumerate(sorted(far))]
        out += [(lang, source, "term", k.decode(), -v, n + 1) for n, (v, k) in enumerate(sorted(over)[:top])]
    return sorted(out)


def told(found):
    return sorted(tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture
def rows():
    draw = random.Random(7)
    made = []
    for i in range(260):
        lang, source = draw.choice(["en", "en", "de", None]), draw.choice(["a", "a", "a", "b", "é", "\U0001f600", None])
        made.append((prose(i % 90, draw.randint(0, 120)).upper() if i % 7 == 0 else prose(i % 90, draw.randint(0, 120)) + " É1ß_x", lang, source))
    made += [(None, "en", "bare"), ("1 2 3", "en", "bare2"), ("one", "xx", "s"), ("two", "xx", "t"), (None, None, None)]
    return made


def table(docs, rows):
    return docs([(i, *r) for i, r in enumerate(rows)])


def test_all_pairs_and_terms(docs, rows):
    assert told(divergence.audit(table(docs, rows))) == plain(rows)


def test_cells_and_blocks_do_not_change_the_sums(docs, rows, monkeypatch):
    monkeypatch.setattr(divergence, "CELL", 100)
    monkeypatch.setattr(divergence, "ROWS", 2)
    monkeypatch.setattr(divergence, "HELD", 500)
    assert told(divergence.audit(table(docs, rows))) == plain(rows)


def test_odd_rows_and_empty_table(docs, odd):
    rows = [(r.text, r.lang, r.source) for r in odd.collect()] * 30
    many = odd
    for _ in range(29):
        many = many.union(odd)
    assert told(divergence.audit(many)) == plain(rows)
    assert divergence.audit(docs([])).count() == 0


def test_sums_of_distances():
    draw = np.random.default_rng(1)
    shares, points = draw.integers(0, 50, 40), draw.integers(0, 60, 30)
    assert divergence._distances(shares, points).tolist() == [int(np.abs(shares - p).sum()) for p in points]
    assert divergence._distances(shares[:0], points).tolist() == [0] * 30
