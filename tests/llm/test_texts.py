"""Operators on texts against plain versions of their rules: fixtures with awkward rows, then the smallest tables."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from quirework.llm import catalog, mixing, ngram_join, packing, pii, quality, simhash, token_codes, toxicity
from quirework.llm.tokens import WordEncoder

from ..conftest import SF_DIR

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, pii string, kept string, "
          "idx long, n long, cls string, part long, size string, copies string")
ODD = [
    (1, "plain words here and there, five or more"), (2, None), (3, ""), (4, " \t\n "), (5, "one"), (5, "one"),
    (6, "Plain WORDS here and there, five or more"), (7, "word " * 30_000), (8, "x" * 100_000), (9, "7" * 100_000),
    (None, "no id at all but some words"), (None, None), (10, "İstanbul ΣΑΣ straße naïve ﬁ 日本語 🙂 it's a\nb  c \x1c d"),
    (11, "mail a.b@c.de x@y.zz_q@r.st now 10.20.30.40 and 1.2.3.4.5.6.7.8 or 999.1.1.1"),
    (12, "card 4111 1111 1111 1111 and 4111-1111-1111-1112 call +1 (555) 123-4567 or +12"),
    (13, "iban DE89 3704 0044 0532 0130 00 and DE89 3704 0044 0532 0130 01 ssn 078-05-1120"),
    (14, "plain words here and there, five or less"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named like those in use."""
    rows = [(i, t, None if k % 3 else "en", None if k % 4 == 0 else f"s{k % 3}", None, 0.5, None, "k", 3, 4, None, 5, "z", None)
            for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]


# -- personal data

def plain_spans(text):
    """The task's rules, word for word."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        total = sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_pii_against_plain_rules(spark):
    rows = docs(spark) + [(9000 + k, t) for k, (_, t) in enumerate(ODD) if t and len(t) < 1000] + [
        (9100, "a@b.c@d.e, a@b.c_x@d.e @x.y a@b a@b. ..@-.- 1-2-3-4-5 6 7890123456789012 +1 2345678901 (2) +"),
        (9101, "1.2.3.4 01.002.3.4 1.2.3 256.1.1.1 1.1.1.1000000000000000000000 4111111111111111111111111")]
    got = pii.digest(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    for r in got:
        text = dict(rows)[r["doc_id"]] or ""
        want = plain_spans(text)
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), (r, text[:200])
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[1] == k for x in want) for k in range(4)]
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if s.split(":")[0] in pii.BASE] == [s for s in said.split(",") if s]


def test_pii_method(spark, odd, none):
    got = {r["doc_id"]: r for r in pii.find_pii(odd, masked=True).collect()}
    assert [s["kind"] for s in got[13]["pii"]].count("iban") == 1 and "ssn" in [s["kind"] for s in got[13]["pii"]]
    assert got[12]["text"].startswith("card <CARD> and") and "555" not in got[12]["text"]
    assert got[2]["text"] is None and got[2]["pii"] == [] and got[9]["text"] == "7" * 100_000
    assert pii.find_pii(odd).count() == len(ODD) and pii.find_pii(none).count() == 0
    assert pii.mask("ab cd ef", [(0, 0, 5, 1.0), (3, 1, 8, 1.0)]) == "<EMAIL>"
    assert not [s for s in pii.spans_of("number 078-05-1120 alone") if s[1] == 5]  # no context, no number


# -- mixing

def test_mixing_targets(spark):
    rows = [("a", 10), ("b", 1), ("c", 1000), (None, 5), ("d", 0)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    weight = {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    stopped, total = set(), sum(n for _, n in rows)
    while True:  # the rule, step by step
        left = total - sum(3 * n for s, n in rows if s in stopped)
        share = sum(weight[s] for s, _ in rows if s not in stopped)
        more = {s for s, n in rows if s not in stopped and weight[s] * left / share > 3 * n}
        if not more:
            break
        stopped |= more
    for s, n in rows:
        assert got[s] == pytest.approx(3 * n if s in stopped else weight[s] * left / share)


def test_mixing_odd_rows(spark, odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
    for source in {r["source"] for r in rows}:
        some = [r for r in rows if r["source"] == source]
        assert sum(r["taken"] for r in some) == int(some[0]["target"])
    again = mixing.mix(odd.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    mixed = mixing.mixed(odd)
    assert mixed.columns == odd.columns
    words = sum(len(WORD.findall(r["text"] or "")) for r in mixed.collect())
    assert words == sum(r["taken"] for r in rows)
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


# -- tokens, their files, packing

@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_word_encoder(spark, name, spaced):
    path = public_tokenizers.path(name)
    plain, mine = Tokenizer.from_file(path), WordEncoder(path, spaced)
    plain.encode_special_tokens = True
    texts = [t for _, t in docs(spark)] + [t for _, t in ODD] + [
        " a", "a ", "a  b", "a \n b", "\n", "it's 'S don’t", "x\x1cy \x85 z", "12,345.67 a.b,c ,. .", "<|endoftext|> hi", "A. B, C.,"]
    for text, ids in zip(texts, mine.encode(texts)):
        want = plain.encode(text or "", add_special_tokens=False).ids
        assert [int.from_bytes(ids[k:k + 4], "little") for k in range(0, len(ids), 4)] == want, (text or "")[:80]


def ids_of(name, texts, end):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    tok.encode_special_tokens = True
    return [tok.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_token_codes_round_trip(spark, odd, none):
    import numpy as np

    for df in (odd, spark.read.parquet(f"{SF_DIR}/documents.parquet")):
        folder = token_codes.new_folder(spark)
        files = token_codes.write_tokens(df, folder, public_tokenizers.path("byte_bpe_50k.json"), 2, True, ids_per_file=5000)
        got = sorted((r["start"], r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids_crc32"])
                     for r in token_codes.read_tokens(files, folder).collect())
        rows = df.select("doc_id", "text").collect()
        want = [(r[0] if r[0] is not None else -1, len(i), crc(i)) for r, i in
                zip(rows, ids_of("byte_bpe_50k.json", [r[1] for r in rows], 2))]
        assert sorted(g[1:] for g in got) == sorted(want)
        assert [g[1] for g in got] == sorted(g[1] for g in got)
        at = 0
        for start, _, n, _ in got:
            assert start == at
            at += n
    folder = token_codes.new_folder(spark)
    files = token_codes.write_tokens(none, folder, public_tokenizers.path("byte_bpe_50k.json"), 2, True)
    assert token_codes.read_tokens(files, folder).count() == 0
    ids = np.random.default_rng(1).choice([0, 5, 255, 256, 300, 65535, 65536, 2 ** 31], 5000).astype(np.uint32)
    codes = token_codes.Codes(token_codes.write_codes(ids, [7], np.array([0, 5000])))
    assert (codes.tokens() == ids).all() and [codes.token(k) for k in range(0, 5000, 7)] == ids[::7].tolist()


def check_packing(rows, want, tokens=2048, segments=256, loss=None):
    """Every id in one piece, sequences gapless, within their limits, and hardly padded."""
    from collections import defaultdict

    seqs, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append(r)
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
    for s in seqs.values():
        s.sort(key=lambda r: r["offset"])
        at = 0
        for r in s:
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= tokens and len(s) <= segments and sum(r["loss_tokens"] for r in s) <= (loss or tokens)
    lengths = [sum(r["length"] for r in s) for s in seqs.values()]
    assert sum(r["length"] for r in rows) == sum(map(len, want))
    for (_, whole), ps in pieces.items():
        assert sum(r["length"] for r in ps) % whole == 0
        if sum(r["length"] for r in ps) == whole:  # one row of this id and length: its pieces follow one another
            at = 0
            for r in sorted(ps, key=lambda r: r["start"]):
                assert r["start"] == at
                at += r["length"]
    return lengths


def test_packing(spark, odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    for df in (odd, spark.read.parquet(f"{SF_DIR}/documents.parquet")):
        rows = packing.pack(df, path, 1, False).collect()
        given = df.select("doc_id", "text").collect()
        want = ids_of("word_bpe_49k.json", [r[1] for r in given], 1)
        lengths = check_packing(rows, want)
        assert all(n == 2048 or n & (n - 1) == 0 for n in lengths)
        by = {}
        for (key, _), ids in zip(given, want):
            by.setdefault((key, len(ids)), []).append(ids)
        for r in rows:
            assert any(crc(ids[r["start"]:r["start"] + r["length"]]) == r["ids_crc32"] for ids in by[r["doc_id"], r["doc_tokens"]])
    assert packing.pack(none, path, 1, False).count() == 0


def test_packing_limits(spark):
    from pyspark.sql import functions as F

    df = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', cast(id * 7 % 90 as int))").alias("text"),
                                 (F.col("id") % 40).alias("prompt")).repartition(2)
    rows = packing.pack(df, public_tokenizers.path("word_bpe_49k.json"), 1, False, tokens=128, segments=4, loss=70,
                        prompt="prompt", pool=64).collect()
    want = ids_of("word_bpe_49k.json", ["word " * (k * 7 % 90) for k in range(400)], 1)
    check_packing(rows, want, 128, 4, 70)
    for r in rows:
        free = max(0, min(r["doc_id"] % 40, r["start"] + r["length"]) - r["start"])
        assert r["loss_tokens"] == r["length"] - free


# -- n-gram join

def plain_groups(rows, size=5, percent=80):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(fold))
        sets.append({tuple(w[k:k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                up[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        ids = [x for x in (least.get(root(k)), i) if x is not None]
        least[root(k)] = min(ids, default=None)
    return sorted(((i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows)), key=str)


def test_ngram_join(spark, odd, none):
    import random

    dice = random.Random(5)
    base = [[dice.choice("abcdefgh") + str(dice.randrange(400)) for _ in range(dice.choice([3, 7, 20, 40, 80]))] for _ in range(12)]
    rows = []
    for k in range(500):
        w = list(base[0] if k % 3 == 0 else dice.choice(base))  # a third of all rows come from one text
        for _ in range(dice.choice([0, 0, 1, 1, 2, 3, 6])):
            w[dice.randrange(len(w))] = f"z{dice.randrange(50)}"
        rows.append((k * 7 % 500, " ".join(w + base[1][:30] * (dice.random() < 0.3))))
    got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == plain_groups(rows)
    assert sorted(map(tuple, ngram_join.similar_groups(odd).collect()), key=str) == plain_groups(ODD)
    assert ngram_join.similar_groups(none).count() == 0


def test_ngram_join_small_units(spark, monkeypatch):
    """Units, parts and tasks far smaller than the groups: the same result."""
    monkeypatch.setattr(ngram_join, "MEMBERS", 8)
    monkeypatch.setattr(ngram_join, "PARTS", 4)
    monkeypatch.setattr(ngram_join, "TASK_ROWS", 500)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(base[:k % 50] + [f"q{k % 13}"] + base[k % 50:])) for k in range(150)]
    got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == plain_groups(rows)


def test_ngram_join_group_names(spark, monkeypatch):
    """A unit of two parts whose smallest class also names the part of another unit: the second unit's way to the other
    part is compared too.  Sets are runs of numbers behind a common smallest one; shifts up to 9 link, from 11 on not."""
    run = lambda at, n=100: np.concatenate([[1], np.arange(1000 + at, 1000 + at + n)]).astype(np.uint64)
    sets = {10: run(0, 103), 12: run(1), 14: run(24), 16: run(25),  # even: first unit, two parts, the first named 10
            11: run(8, 102), 13: run(9), 15: run(16), 17: run(15)}  # odd: second unit, one part named 11
    pure = {k: set(v.tolist()) for k, v in sets.items()}
    linked = lambda a, b: 10 * len(pure[a] & pure[b]) >= 8 * len(pure[a] | pure[b])
    assert linked(10, 11) and linked(11, 15) and linked(15, 14) and not any(linked(a, b) for a in (10, 12, 11, 13) for b in (14, 16))
    rows = [(k, len(v), k, ngram_join._six(v), None) for k, v in sets.items()]
    given = spark.createDataFrame(rows, "doc_id long, n long, cls long, set binary, often array<struct<gram:bigint,n:bigint>>")
    monkeypatch.setattr(ngram_join, "MEMBERS", 4)
    monkeypatch.setattr(ngram_join, "_sets", lambda docs, size: docs)
    assert {r["component_id"] for r in ngram_join.similar_groups(given).collect()} == {10}


# -- fingerprints

def plain_print(text):
    w = WORD.findall(text)
    pairs = list(zip(w, w[1:])) if len(w) > 1 else [(x, "") for x in w]
    votes, total = [0] * 64, 0
    for a, b in pairs:
        h = xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42))
        n = min(len(a) + len(b), simhash.HEAVIEST)
        total += n
        for i in range(64):
            votes[i] += n * (h >> i & 1)
    return sum(1 << i for i in range(64) if 2 * votes[i] > total)


def test_simhash(spark, odd, none):
    rows = docs(spark) + [(5000, None), (5001, ""), (5002, "one"), (5003, "a b c d e"), (5003, "a b c d e"), (None, "x y z w")]
    order = [(None, "x y z w")] + sorted({(i, t or "") for i, t in rows if i is not None})
    want = {}
    for k, (i, t) in enumerate(order):
        next_ = order[(k + 1) % len(order)][1]
        edited = t[:len(t) - len(t) // 4] + next_[:len(t) // 4]
        a, b, c = plain_print(t), plain_print(edited), plain_print(next_)
        want[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{a:016x}", f"{b:016x}",
                   1 - (a ^ b).bit_count() / 64, 1 - (a ^ c).bit_count() / 64)
    got = simhash.compare_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == want[r["doc_id"]]
    longer = [r for r in got if r["n_chars"] > 200]
    assert sum(r["near_edited"] > r["near_next"] for r in longer) >= 0.97 * len(longer)
    assert simhash.compare_edits(odd).count() == len(ODD) and simhash.compare_edits(none).count() == 0
    assert simhash.compare_edits(odd.limit(1)).count() == 1


def test_simhash_near(spark):
    import random

    dice = random.Random(3)
    seeds = [dice.getrandbits(64) for _ in range(40)]
    prints = set(seeds)
    for s in seeds:
        for _ in range(6):
            prints.add(s ^ sum(1 << b for b in dice.sample(range(64), dice.randrange(1, 6))))
    signed = {p - (1 << 64) if p >> 63 else p for p in prints}
    got = {tuple(r) for r in simhash.near(spark.createDataFrame([(p,) for p in signed] * 2, "bits long"), 3).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 3}
    assert got == want and want


# -- classifiers

def test_classifiers_odd_rows(spark, odd, none, labels):
    for module in (toxicity, quality):
        model = module.train(odd, labels)  # no label: nothing to learn from
        rows = module.score(odd, model).collect()
        assert len(rows) == len(ODD)
        assert module.score(none, model).count() == 0
    assert all(r["kept"] for r in quality.score(odd, quality.train(odd, labels)).collect())
    some = spark.createDataFrame([(1, 1, 0), (6, 0, None), (8, None, 1), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(odd, quality.train(odd, some)).count() == len(ODD)
    assert {r["predicted"] for r in toxicity.score(odd, toxicity.train(odd, some)).collect()} <= {0, 1}


def test_classifiers_held_out(spark):
    """Accuracy on the fold that no model learns from."""
    sf_dir = "/root/testdata/sf0.1"
    known = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in catalog.QUERIES["op1_toxicity"](spark, sf_dir).collect() if r["held_out"] and r["doc_id"] in known]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and 0 <= r["score"] <= 1 for r in rows)
    hits = [(r["predicted"], known[r["doc_id"]]["toxic"]) for r in rows]
    assert sum(p for p, y in hits if not y) <= 0.01 * len(hits) and sum(p for p, y in hits if y) >= 0.85 * sum(y for _, y in hits)
    rows = [r for r in catalog.QUERIES["op10_quality"](spark, sf_dir).collect() if r["held_out"] and r["doc_id"] in known]
    hits = [(r["kept"], known[r["doc_id"]]["quality"]) for r in rows]
    assert sum(p for p, y in hits if y) >= 0.97 * sum(y for _, y in hits) and sum(p == y for p, y in hits) >= 0.96 * len(hits)


def test_quality_of_text_without_spaces(spark):
    """Long texts without spaces that turn bad after their start are told from those that don't."""
    import random

    dice = random.Random(2)
    clean = lambda n: "".join(dice.choice("天地玄黃宇宙洪荒日月盈昃辰宿列張") for _ in range(n))
    rows = [(k, clean(100) + "%#" * 150 if k % 2 else clean(400)) for k in range(400)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(k, 1 - k % 2, 0) for k, _ in rows], "doc_id long, quality int, toxic int")
    got = [r for r in quality.score(texts, quality.train(texts, known)).collect() if r["held_out"]]
    assert len(got) > 40 and sum(r["kept"] == (r["doc_id"] % 2 == 0) for r in got) >= 0.95 * len(got)


def test_shapes_of_whole_pieces():
    from quirework.llm import hashed

    table = hashed.tables(hashed.style)
    of = lambda text: {b: v for b, v in hashed.style(text, table).items() if v != 1.0}
    a, junk = hashed.bucket("shape:a"), hashed.bucket("shape:#")
    assert of("x" * 128 + "#" * 64) == {a: (2 / 3) ** 0.5, junk: (1 / 3) ** 0.5}


def test_factorization_learns_pairs():
    """Terms that are harmless alone and toxic together: only the pairwise part can tell."""
    import numpy as np

    dice = np.random.default_rng(0)
    on = dice.random((600, 6)) < 0.5
    y = (on[:, 0] == on[:, 1]).astype(float)
    rows, cols = np.nonzero(on)
    start = dice.normal(0, 0.2, (6, 4))
    machine = toxicity.Machine(np.arange(6), np.zeros(1), np.zeros(6), start).fit(rows, cols, np.ones(len(rows)), y, 800, 1e-6)
    assert ((machine.scores(rows, cols, np.ones(len(rows)), 600) >= 0.5) == y).mean() > 0.95


def test_ordinal_thresholds():
    import numpy as np

    dice = np.random.default_rng(0)
    x = dice.normal(size=900)
    y = np.digitize(x + dice.normal(0, 0.2, 900), [-0.5, 0.8])
    model = quality.Ordinal(np.arange(1), np.zeros(1), np.zeros(2)).fit(np.arange(900), np.zeros(900, int), x, y, 800, 0.0)
    assert (np.diff(model.thresholds()) > 0).all()
    expected = (1 - model.below(np.arange(900), np.zeros(900, int), x, 900)).sum(axis=1)
    assert np.corrcoef(expected, y)[0, 1] > 0.9


def test_worker_memory_goes_to_the_running_step():
    """Caches of one step are empty once another one runs, and are kept from task to task of the same step."""
    from quirework.llm import hashed, tokens
    from quirework.llm.common import claim

    path = public_tokenizers.path("word_bpe_49k.json")
    enc = tokens.encoder(path, False)
    enc.encode(["some words"])
    assert tokens.encoder(path, False) is enc
    words = hashed.tables(hashed.presence)
    assert words["some"] and not tokens._ENCODERS
    assert hashed.tables(hashed.presence) is words
    claim("ngrams")
    assert not hashed._TABLES
    assert tokens.encoder(path, False).encode(["some words"]) == enc.encode(["some words"])
