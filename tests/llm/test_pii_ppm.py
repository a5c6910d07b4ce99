import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.llm import pii, ppm
from ledgerloom.llm.common import slices


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


TEXTS = ["Write to Ana.Ruiz@Mail.example.com or ana.ruiz@mail.example.com, or call +1 (017) 555-7713 today.",
         "Card 4111 1111 1111 1111 or 4111111111111111, not 4111111111111112; ssn 123-45-6789, host 10.20.30.40.",
         "Mr John Smith met Mrs. Anna Smith and Dr Lee; Г-н нет, Господин Иван Петров да.",
         "version 1.2.3, 10.20.30.40.50 and 300.1.1.1 stay; so does 2024-01-02.", "same host 10.20.30.40 and +1 (017) 555-7713"]


def test_surrogates_by_type(make_docs):
    rows = {r["doc_id"]: r for r in pii.op10(make_docs(TEXTS)).collect()}
    mails = re.findall(r"\S+@\S+\.com", rows[0]["text"])
    assert len(mails) == 2 and mails[0].lower() == mails[1].lower().rstrip(",") and mails[0] != mails[1]
    assert mails[0][0].isupper() and mails[0][4].isupper() and "ruiz" not in rows[0]["text"].lower()
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", rows[0]["text"])[0]
    assert phone != "+1 (017) 555-7713" and phone in rows[4]["text"]
    cards = re.search(r"Card (\d{4} \d{4} \d{4} \d{4}) or (\d{16}), not 4111111111111112; ssn (\d{3}-\d{2}-\d{4}), host (\S+)\.$", rows[1]["text"])
    assert cards[1].replace(" ", "") == cards[2] != "4111111111111111" and luhn(cards[2]) and cards[2][0] == "4"
    assert cards[3] != "123-45-6789" and cards[4] != "10.20.30.40" and cards[4] in rows[4]["text"]
    assert rows[3]["text"] == TEXTS[3]
    names = re.fullmatch(r"Mr (\w+) (\w+) met Mrs\. (\w+) (\w+) and Dr (\w+); Г-н нет, Господин (\w+) (\w+) да\.", rows[2]["text"])
    assert names[2] == names[4] != "Smith" and names[1] != names[3] and names[5] != "Lee"
    assert names[1].lower() in pii.NAMES["latin"]["m"] and names[3].lower() in pii.NAMES["latin"]["f"]
    assert re.fullmatch(r"[А-Яа-яё]+", names[6]) and re.fullmatch(r"[А-Яа-яё]+", names[7])


def test_key_changes_surrogates(make_docs):
    docs = make_docs(TEXTS)
    one, two, again = (pii.replace_pii(docs, key=k).filter("doc_id = 0").first()["text"] for k in ("a", "b", "a"))
    assert one == again != two


def test_distinct_stays_distinct(spark):
    entities = spark.range(3000).select(F.when(F.col("id") % 2 == 0, "family:latin").otherwise("ip").alias("kind"),
                                        F.when(F.col("id") % 2 == 0, F.concat(F.lit("na"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")))
                                        .otherwise(F.concat(F.lit("10.0."), (F.col("id") / 200).cast("int"), F.lit("."), F.col("id") % 200)).alias("value"))
    rows = pii.surrogates(entities, "k").collect()
    real = {(r["kind"], r["value"]) for r in rows}
    new = {(r["kind"], r["surrogate"]) for r in rows}
    assert len(rows) == len(new) == 3000 and not real & new


def drawn(spark, kind, values, key="k"):
    rows = pii.surrogates(spark.createDataFrame([(kind, v) for v in values], "kind string, value string"), key).collect()
    return {r["value"]: r["surrogate"] for r in rows}


def test_small_and_empty_spaces_end(spark, make_docs):
    """Mailboxes that fill their space, hosts without letters, one-letter names: every draw can differ in the end."""
    letters = [f"{chr(97 + i)}@x.org" for i in range(26)]
    new = drawn(spark, "email", [*letters, "_@-.com", "_@x.org", "-@-.com"])
    assert len(set(new.values())) == len(new) == 29 and not set(new) & set(new.values())
    assert {v.split("@")[1] for k, v in new.items() if k.endswith("@x.org")} == {new["a@x.org"].split("@")[1]}
    assert len({v.split("@")[1] for v in new.values()}) == 2
    assert pii.op10(make_docs(["write to _@-.com now"])).first()["text"] != "write to _@-.com now"


def test_a_full_space_of_numbers_is_an_error(spark, monkeypatch):
    import pytest
    monkeypatch.setattr(pii, "ROUNDS", 3)
    with pytest.raises(RuntimeError):
        drawn(spark, "phone", [f"1{i}" for i in range(10)])  # one digit is free, all ten are taken


def test_names_read_as_their_gender(spark):
    """Two thousand given names of each gender (fewer in other scripts): distinct, unlike the originals, of the gender's endings."""
    own = {(script, g): [letters + "".join(letters[int(c, 4)] for c in np.base_repr(i, 4)) for i in range(first, first + n)]
           for script, letters, n in (("latin", "give", 2000), ("cyrillic", "имяу", 300), ("greek", "ονεμ", 300)) for g, first in (("m", 64), ("f", 5000))}
    entities = spark.createDataFrame([(f"{g}:{script}", v) for (script, g), names in own.items() for v in names], "kind string, value string")
    rows = pii.surrogates(entities, "k").collect()
    for script in pii.STEMS:
        mine = [r for r in rows if r["kind"].endswith(script)]
        made = {r["surrogate"] for r in mine}
        assert len(made) == len(mine) == len({r["value"] for r in mine}) and not made & {r["value"] for r in mine}
        for gender, other in ("mf", "fm"):
            new = [r["surrogate"] for r in mine if r["kind"][0] == gender]
            listed = set(pii.NAMES[script][gender].split())
            ends, others = (tuple(pii.STEMS[script][g].split()) for g in (gender, other))
            assert len(new) == len(own[script, gender]) and sum(v in listed or v.endswith(ends) and not v.endswith(others) for v in new) > 0.95 * len(new)


def test_distinct_and_coreferent_over_a_corpus(make_docs):
    """Planted entities in many documents: one surrogate for each entity everywhere, no two alike, none of the originals."""
    import random
    g = random.Random(12)
    digits = lambda n: "".join(g.choice("0123456789") for _ in range(n))

    def card():
        d = "4" + digits(14)
        return next(d + c for c in "0123456789" if luhn(d + c))
    given, family = ["Ana", "John", "Marie", "Peter", "Olga", "Tom"], ["Smith", "Ruiz", "Fischer", "Moreau", "Lindt"]
    pool = {"email": [f"{a}.{b}@{c}.example.org" for a in "abc" for b in ("lee", "kim") for c in ("one", "two", "ten")],
            "phone": [f"+1 {digits(3)} {digits(3)} {digits(4)}" for _ in range(30)], "ssn": [f"{digits(3)}-{digits(2)}-{digits(4)}" for _ in range(30)],
            "ip": [f"10.{g.randrange(256)}.{g.randrange(256)}.{g.randrange(1, 255)}" for _ in range(30)], "card": [card() for _ in range(20)]}
    docs = []
    for _ in range(120):
        who = f"Mr {g.choice(given)} {g.choice(family)}"
        docs.append(" | ".join([who, *(g.choice(pool[k]) for k in pool), who.split()[1] + " again"]))
    out = {r["doc_id"]: r["text"] for r in pii.op10(make_docs(docs)).collect()}
    forward, backward = defaultdict(set), defaultdict(set)
    for i, text in enumerate(docs):
        a, b = text.split(" | "), out[i].split(" | ")
        assert len(a) == len(b) and a[-1].split()[0] != b[-1].split()[0] == b[0].split()[1]
        for kind, x, y in [("given", a[0].split()[1], b[0].split()[1]), ("family", a[0].split()[2], b[0].split()[2]), *zip(pool, a[1:], b[1:]),
                           ("domain", a[1].split("@")[1], b[1].split("@")[1])]:
            forward[kind, x].add(y)
            backward[kind, y].add(x)
    assert all(len(v) == 1 for v in [*forward.values(), *backward.values()])
    assert not {(k, y) for (k, _), ys in forward.items() for y in ys} & set(forward)


def test_clean_documents_are_left_alone(documents, texts):
    out = {r["doc_id"]: r for r in pii.op10(documents).collect()}
    assert set(out) == set(texts)
    found = re.compile(r"@|\d{13}|\+\d|\d+\.\d+\.\d+\.\d+|\d{3}-\d{2}-\d{4}")
    for d, t in texts.items():
        if not found.search(t):
            assert out[d]["text"] == t
    mails = {m for t in texts.values() for m in re.findall(r"[\w.]+@[\w.]+\w", t) if m.isascii()}
    assert mails and not any(m in r["text"] for m in mails for r in out.values())


def test_pii_edges(edge_docs, no_docs, make_docs):
    assert pii.op10(no_docs).count() == 0
    out = pii.stage(edge_docs)
    assert out.columns == edge_docs.columns
    key = lambda df: sorted((str(r["doc_id"]), str(r["text"])) for r in df.collect())
    assert key(out) == key(edge_docs)
    long = make_docs(["x " * 20000 + "a@b.org " * 3000 + "end"] * 2, [1, 1])
    rows = pii.op10(long).collect()
    assert [r["n_email"] for r in rows] == [3000, 3000] and rows[0]["text"] == rows[1]["text"] and "a@b.org" not in rows[0]["text"]


def test_names_whole_and_without_title(make_docs):
    own = ["Mr John Smith came. Smith said so, and SMITH's friend John Smith left Paris.", "Dr Anna Smith met Mrs Anna Smith.",
           "Mr McDonald and Mr John Fitzgerald Kennedy, Mr J. Smith, Mrs O'Brien, Mr SMITH, Herr Ludwig van Beethoven, Mrs Smith-Jones.",
           "No title here: Smith, John, Anna, Beethoven.", "Dr. Jane O’Brien's plan; O'Brien wrote it. Jane.Doe was not Jane2. I am A."]
    out = {r["doc_id"]: r["text"] for r in pii.op10(make_docs(own)).collect()}
    john, smith, again, other, first, last = re.fullmatch(
        r"Mr (\w+) (\w+) came\. (\w+) said so, and (\w+)'s friend (\w+) (\w+) left Paris\.", out[0]).groups()
    assert john == first != "John" and smith == again == last != "Smith" and other == smith.upper()
    anna, s1, again, s2 = re.fullmatch(r"Dr (\w+) (\w+) met Mrs (\w+) (\w+)\.", out[1]).groups()
    assert anna == again != "Anna" and s1 == s2 == smith and anna.lower() in pii.NAMES["latin"]["f"]
    names = re.fullmatch(r"Mr (\w+) and Mr (\w+) (\w+) (\w+), Mr (\w)\. (\w+), Mrs (\w+), Mr (\w+), Herr (\w+) van (\w+), Mrs (\w+)-(\w+)\.", out[2]).groups()
    assert not set(names) & {"McDonald", "John", "Fitzgerald", "Kennedy", "J", "Smith", "SMITH", "Ludwig", "Beethoven", "Jones"}
    assert names[1] == john and names[5] == smith == names[10] and names[7] == smith.upper()
    assert out[3] == own[3]
    jane, obrien, later, untitled = re.fullmatch(r"Dr\. (\w+) (\w+)'s plan; (\w+) wrote it\. (\w+)\.Doe was not Jane2\. I am A\.", out[4].replace("’", "'")).groups()
    assert jane == untitled != "Jane" and obrien == later == names[6]


def test_phone_forms(make_docs):
    own = ["+33 1 23 45 67 89", "555.123.4567", "1-800-555-1234", "555-123-4567", "(555) 123-4567", "1 (555) 123-4567", "+442079460958",
           "01 23 45 67 89", "+49 89 12 34 56", "212 555 0123", "+91 98765 43210"]
    rows = pii.op10(make_docs([f"call {t}, now" for t in own])).collect()
    for r in rows:
        t = own[r["doc_id"]]
        new = r["text"][5:-5]
        assert r["n_phone"] == 1 and new != t and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", t), t
    kept = ["in 2024-01-02 or 1.2.3.4567", "100 200 3000 of them", "1,555,123.4567"]
    assert sorted(r["text"] for r in pii.op10(make_docs(kept)).collect()) == sorted(kept)


K = ppm.ORDER


def symbols(text):
    return b"\xfe" * K + b"".join(w + b" " for w in (text or "").encode().lower().split()) + b"\xff"


class Brute:
    def __init__(self, train):
        self.counts, self.words = [defaultdict(Counter) for _ in range(K + 1)], Counter()
        for t in train:
            s = symbols(t)
            self.words.update([*(t or "").encode().lower().split(), None])
            for j in range(K, len(s)):
                for k in range(K + 1):
                    self.counts[k][s[j - k:j]][s[j]] += 1
        self.n, self.v = sum(self.words.values()), len(self.words)

    def log10(self, context, symbol):
        out, excluded = 0.0, set()
        for k in range(K, -1, -1):
            seen = self.counts[k].get(context[K - k:])
            if seen is None:
                continue
            total = sum(c for s, c in seen.items() if s not in excluded)
            kinds = len(set(seen) - excluded)
            if symbol in seen:
                return out + math.log10(seen[symbol] / (total + kinds))
            out += math.log10(kinds / (total + kinds)) if kinds else 0
            excluded |= set(seen)
        return out - math.log10(255 - len(excluded))

    def score(self, text):
        s = symbols(text)
        w = [*(text or "").encode().lower().split(), None]
        base = sum(math.log10((self.words[x] + 0.1) / (self.n + 0.1 * (self.v + 1))) for x in w)
        return len(w), sum(self.words[x] > 0 for x in w), self.n, base, sum(self.log10(s[j - K:j], s[j]) for j in range(K, len(s)))


def held(d):
    return zlib.crc32((str(d) if d is not None else "").encode()) % 10 == 0


def check(rows, docs, only=None):
    model = Brute([t for d, t in docs if not held(d)])
    want = defaultdict(list)
    for d, t in docs:
        if only is None or d in only:
            want[d].append((held(d), *model.score(t)))
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]))
    for d in want:
        for a, b in zip(sorted(want[d]), sorted(got[d]), strict=True):
            assert a[:4] == b[:4] and all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a[4:], b[4:]))
    return model


def test_scores(documents, texts):
    rows = ppm.op7(documents).collect()
    assert len(rows) == len(texts)
    model = check(rows, list(texts.items()), set(sorted(texts)[:40]))
    for context in (b"\xfe" * K, b"the ", b"zzzz"):
        assert math.isclose(sum(10 ** model.log10(context, s) for s in range(256) if s != 0xFE), 1, rel_tol=1e-9)


def test_score_edges(edge_docs, no_docs, make_docs):
    assert ppm.op7(no_docs).count() == 0
    check(ppm.op7(edge_docs).collect(), [(r["doc_id"], r["text"]) for r in edge_docs.collect()])
    untrained = [d for d in range(200) if held(d)][:2]
    check(ppm.op7(make_docs(["ab c", None], untrained)).collect(), list(zip(untrained, ["ab c", None])))


def test_a_block_is_listed_in_little_memory():
    texts = [f"{i} some few words that come again and again " * 40 for i in range(2000)]
    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts, "train": [True] * len(texts)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        for part in slices(rows, "text", ppm.PART):
            writer.write_batch(part)
    block = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "payload"])
    tracemalloc.start()
    listed = sum(b.num_rows for b in ppm._vocabulary(iter([block])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert listed > 2000 and most < 32 << 20, most
