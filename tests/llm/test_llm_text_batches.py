import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from auditspark.llm.batches import WORD, pieces, whole_windows
from auditspark.llm.textstats import Words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té中A.!", max_size=30)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_lines_and_repeats_are_those_of_plain_python(texts):
    seen = 0
    for piece in pieces(pa.array(texts, pa.string())):
        words = Words(piece)
        raw = [(texts[piece.first + i] or "") for i in range(piece.n)]
        starts, ends, of = piece.spans(WORD)
        found = [bytes(piece.data[a:b]).decode() for a, b in zip(starts, ends)]
        plain = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in raw]
        assert found == [w for t in plain for w in t] and of.tolist() == [i for i, t in enumerate(plain) for _ in t]
        a, b, text = piece.lines()
        assert [(int(t), bytes(piece.data[x:y]).decode()) for x, y, t in zip(a, b, text)] == [(i, line) for i, t in enumerate(raw) for line in t.split("\n")]
        for i, t in enumerate(plain):
            keys = [tuple(t[k:k + 3]) for k in range(len(t) - 2)]
            marked = {k + s for k in range(len(keys)) if keys.count(keys[k]) > 1 for s in range(3)}
            assert words.repeated()[i] == len(marked)
        equal = {}
        for h, w in zip(words.hashes, found):
            assert equal.setdefault(w, h) == h
        assert len(set(equal.values())) == len(equal)
        seen += piece.n
    assert seen == len(texts)


def test_sliced_columns_and_long_texts_keep_their_places():
    column = pa.array(["skip", "a b", None, "c " * 700_000, "d"]).slice(1)
    got = [(p.first + i, n) for p in pieces(column) for i, n in enumerate(np.bincount(p.spans(WORD)[2], minlength=p.n))]
    assert got == [(0, 2), (1, 0), (2, 700_000), (3, 1)]
    assert whole_windows(np.array([0, 0, 0, 1, 1]), 3).tolist() == [0]
