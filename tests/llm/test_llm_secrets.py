import base64
import hashlib
import math
import random
import re
import string
import time

from auditspark.llm import secrets
from prose import prose

ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


CASES = [
    "", "password=hunter22 and PassWord: 'abcdef'", "secret: token :abcdefgh", "api_key = \"abc\" apikey=abcdefgh.x", "\U0001f600 token=a1b2c3d4e5 é token=zzzzzz",
    "AKIA" + "B" * 16 + " AKIAAKIA" + "C" * 12 + " AKIASHORT", "f" * 24 + "g" + "0" * 23 + " " + "1a" * 20, "token=" + "0123456789abcdef" * 2 + " tail", "token\n= abcdefgh token=\nabcdefgh",
]


def test_base_spans_are_those_of_plain_python(spark, docs):
    documents = docs(list(enumerate(CASES)))
    for r in secrets.scan(documents, secrets.train(documents)).collect():
        want = plain(CASES[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [want.count(k) for k in ("assign:", "access:", "hex:")]
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))


def test_models_tell_random_strings_from_identifiers(spark, docs):
    words = docs([(i, re.sub("[0-9]", "", prose(i, 200)) + " first_value_of_2 read-only-list3") for i in range(30)])
    ratios = secrets.train(words)
    strings = {1: "aB3dE5fG7hJ9kL1mN2pQ", 2: "ghp_16C7e42F292c6912E7710c838347Ae178B4a", 3: "x9Kq2ZpLw8Vr4TnB6yHs0Dfg"}
    names = {4: "information_system2_program", 5: "community-president-2-education", 6: "4111111111111111", 7: "192.168.100.200 mail8.example.com", 8: "morningresearchgirl"}
    found = {r["doc_id"]: r["spans"] for r in secrets.scan(docs([(k, f"see {v} here") for k, v in {**strings, **names}.items()]), ratios).collect()}
    assert {k: found[k] for k in strings} == {k: f"random:4:{4 + len(v)}" for k, v in strings.items()}
    assert all(found[k] == "" for k in names)


def test_keys_of_letters_are_found_and_names_of_letters_are_not(spark, docs):
    draw = random.Random(2)
    ratios = secrets.train(docs([(i, prose(i, 200)) for i in range(30)]))
    keys = ["".join(draw.choices(string.ascii_letters, k=24)) for _ in range(200)]
    names = [prose(900 + i, 4).replace(" ", "") + "ending" for i in range(100)] + [prose(900 + i, 5).title().replace(" ", "") for i in range(100)]
    names = [n for n in (re.sub("[^A-Za-z]", "", n) for n in names) if len(n) >= 16]
    found = {r["doc_id"]: r["spans"] for r in secrets.scan(docs(list(enumerate(keys + names))), ratios).collect()}
    assert sum(found[i] != "" for i in range(200)) >= 190
    assert len(names) >= 100 and sum(found[200 + i] != "" for i in range(len(names))) <= len(names) // 50


def test_many_spans_keep_their_places(spark, docs):
    """More spans than one part holds, of all kinds, overlapping too, against plain loops."""
    draw = random.Random(4)
    words = ["é word", "token=" + "0a" * 12, "AKIA" + "B" * 16, "password: abcdefgh", "x9Kq2ZpLw8Vr4TnB6yHs0Dfg", "secret=aB3dE5fG7hJ9kL1mN2pQ", "\U0001f600"]
    texts = [" ".join(draw.choices(words, k=n)) for n in (0, 1, 127, 128, 129, 700, 2000)]
    documents = docs(list(enumerate(texts)))
    ratios = secrets.train(docs([(i, prose(i, 200)) for i in range(30)]))
    gone = {r["doc_id"]: r["text"] for r in secrets.redacted(documents, ratios).collect()}
    for r in secrets.scan(documents, ratios).collect():
        text, want = texts[r["doc_id"]], plain(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        base = [(int(a), int(b)) for _, a, b in (x.split(":") for x in want.split(",") if x)]
        runs = [m.span() for m in re.finditer("x9Kq2ZpLw8Vr4TnB6yHs0Dfg", text)]
        added = [x.split(":") for x in r["spans"].split(",") if x.startswith("random")]
        assert [(int(a), int(b)) for _, a, b in added] == [(a, b) for a, b in runs if not any(c < b and a < d for c, d in base)]
        out, at = "", 0
        for a, b in sorted(base + runs):
            out += "" if a < at else text[at:a] + secrets.REDACTION
            at = max(at, b)
        assert gone[r["doc_id"]] == out + text[at:]


def test_time_grows_as_the_text(spark, docs):
    draw = random.Random(3)
    one = " ".join("".join(draw.choices(string.ascii_letters + string.digits, k=20)) for _ in range(40_000))
    ratios = secrets.train(docs([(i, prose(i, 200)) for i in range(30)]))
    began = time.monotonic()
    made = secrets.redacted(docs([(1, one)]), ratios).collect()
    assert made[0]["text"].count(secrets.REDACTION) > 39_000
    assert time.monotonic() - began < 60


def test_plan_has_no_python(spark, docs):
    documents = docs([(1, "token=abcdefgh")])
    for made in (secrets.scan(documents, secrets.train(documents)), secrets.redacted(documents, secrets.train(documents))):
        assert not re.search("Python|Pandas|Arrow", made._jdf.queryExecution().executedPlan().toString())


def test_redaction_replaces_every_span_and_keeps_all_else(spark, docs, odd):
    documents = docs([(1, "a token=abcdefgh b é " + "ab12" * 10, "en", "s", 5), (2, "nothing", "en", "s", 7), (3, "token=" + "0a" * 12)])
    ratios = secrets.train(documents)
    found = {r["doc_id"]: r for r in secrets.redacted(documents, ratios).collect()}
    assert found[1]["text"] == "a [SECRET] b é [SECRET]" and found[1]["n_chars"] == len(found[1]["text"])
    assert found[2]["text"] == "nothing" and found[2]["n_chars"] == 7 and found[3]["text"] == "[SECRET]"
    made = secrets.redacted(odd, ratios)
    assert made.columns == odd.columns and made.exceptAll(odd).count() == 0 == odd.exceptAll(made).count()
    assert secrets.scan(odd, ratios).where("spans <> ''").count() == 0
    assert secrets.scan(documents.limit(0), secrets.train(documents.limit(0))).count() == 0


def test_models_are_counted_over_all_documents(spark, docs):
    texts = [f"{prose(i, 30)} a__b_ _lead trail_ word-with-hyphen été x_{i}y token=aB3dE5fG7{i}" for i in range(40)]
    rows = list(enumerate(texts)) + [(None, "no_id_here zq" + "zq" * 5)]
    n = secrets._N
    counted = [[1] * (n * n) for _ in range(2)]

    def count(label, token):
        codes = [secrets.ALPHABET.find(c) + 1 for c in token]
        for a, b in zip(codes, codes[1:]):
            counted[label][a * n + b] += 1

    for _, text in rows:
        for m in ASSIGN.finditer(text):
            count(1, m[1])
        left = text
        for pattern in (ASSIGN.pattern, secrets.ACCESS, "[0-9a-f]{24,}", secrets.TOKEN):
            left = re.sub(pattern, " ", left)
        for form in (left, left.replace(" ", "_")):
            for token in re.findall("[A-Za-z_][A-Za-z0-9_-]{3,}", form):
                count(0, token)
    for i in range(secrets.MADE):
        count(1, base64.b64encode(hashlib.sha256(str(i).encode()).digest()).decode())
    chance = [[math.log(c / sum(of[k // n * n:k // n * n + n])) for k, c in enumerate(of)] for of in counted]
    want = [r - o for o, r in zip(*chance)]
    assert max(abs(a - b) for a, b in zip(secrets.train(docs(rows)), want)) < 2e-6
