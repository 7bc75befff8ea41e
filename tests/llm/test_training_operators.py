"""Whitening, personal data and fill-in-the-middle against brute force, SQL and round trips."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from pairloom.llm import fill_middle, private_data, quality, whitening


def same(df, sql, rows, schema="doc_id long, text string"):
    """Whether a query's rows are those of its SQL over ``rows``."""
    connection = duckdb.connect()
    table = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype({"doc_id": "Int64"})
    connection.register("documents", table)
    want = connection.sql(sql).fetchall()
    names = [d[0] for d in connection.sql(sql).description]
    got = [tuple(r[n] for n in names) for r in df.collect()]
    return sorted(map(str, got)) == sorted(map(str, want))


# -- whitening ------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<float>, label int, n long, x string"


def brute(vectors, most=32):
    """Row sums of squares, whitened rows and shares by numpy and Python's integers."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, total = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, total, strict=True)) for row in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(row, total, strict=True)] for row in x])
    cov = centred.T @ centred / n
    e, axes = np.linalg.eigh(cov)
    keep = [k for k in np.argsort(-e)[:most] if e[k] > 1e-9 * np.trace(cov)]
    return deviation, centred @ axes[:, keep] / np.sqrt(e[keep]), e[keep] / np.trace(cov)


@pytest.mark.parametrize("spread", [1.0, 3e7])
def test_whitening(spark, spread):
    """The second spread sums its products as decimals."""
    r = np.random.default_rng(3)
    base = (r.normal(size=(90, 40)) * np.linspace(1, 3, 40) * spread).astype(np.float32).tolist()
    base[7] = base[3]  # a copy
    rows = [(k, v, 1, 2, "x") for k, v in enumerate(base)]
    odd = [(901, None, 1, 2, "x"), (902, [], 1, 2, "x"), (903, [1.0] * 39, 1, 2, "x"), (904, [*base[0][:-1], None], 1, 2, "x")]
    odd += [(905, [*base[0][:-1], float("nan")], 1, 2, "x"), (906, [*base[0][:-1], float("-inf")], 1, 2, "x"), (907, [*base[0][:-1], 3e38], 1, 2, "x")]
    got = whitening.whiten(spark.createDataFrame(rows + odd, VECTORS).repartition(5)).collect()
    deviation, whitened, shares = brute(base)
    assert len(got) == 90 * 32 and {r.n for r in got} == {90}
    table = np.zeros((90, 32))
    for row in got:
        table[row.vec_id, row.component - 1] = row.whitened
        assert row.deviation == (deviation[row.vec_id] if deviation[row.vec_id] < 2**63 else None)
        assert abs(row.explained / shares[row.component - 1] - 1) < 1e-9 and row.identity_error < 1e-9
    signs = np.sign((table * whitened).sum(0))
    assert np.abs(table - whitened * signs).max() < 1e-6
    assert np.abs(np.cov(table.T, bias=True) - np.eye(32)).max() < 1e-9


def test_whitening_is_the_same_for_any_layout(spark):
    r = np.random.default_rng(4)
    df = spark.createDataFrame([(k, v, 1, 2, "x") for k, v in enumerate(r.normal(size=(200, 12)).tolist())], VECTORS)
    one, many = ({(r.vec_id, r.component): (r.whitened, r.explained) for r in whitening.whiten(df.repartition(p)).collect()} for p in (1, 17))
    assert one.keys() == many.keys() and len(one) == 2400
    assert all(abs(a - many[k][0]) < 1e-12 and b == many[k][1] for k, (a, b) in one.items())


def test_whitening_of_few_rows(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert make([]) == [] and make([(1, None, 1, 2, "x")]) == [] and make([(1, [1.0, 2.0], 1, 2, "x")]) == []
    assert make([(k, [1.0, 2.0], 1, 2, "x") for k in range(3)]) == []  # no variance at all
    flat = make([(None if k == 1 else k, [float(k), 5.0], 1, 2, "x") for k in range(4)])  # one direction without any
    assert len(flat) == 4 and {r.component for r in flat} == {1} and {r.explained for r in flat} == {1.0} and None in {r.vec_id for r in flat}
    wide = whitening.whiten(spark.createDataFrame([(k, np.eye(6)[k].tolist(), 1, 2, "x") for k in range(6)], VECTORS), components=2).collect()
    assert {r.component for r in wide} == {1, 2}


def test_whitening_in_several_aggregations(spark, monkeypatch):
    monkeypatch.setattr(whitening, "EXPRESSIONS", 7)
    r = np.random.default_rng(5)
    base = r.normal(size=(30, 6)).astype(np.float32).tolist()
    got = whitening.whiten(spark.createDataFrame([(k, v, 1, 2, "x") for k, v in enumerate(base)], VECTORS)).collect()
    table = np.zeros((30, 6))
    for row in got:
        table[row.vec_id, row.component - 1] = row.whitened
    _, whitened, _ = brute(base)
    assert np.abs(table - whitened * np.sign((table * whitened).sum(0))).max() < 1e-9


# -- personal data --------------------------------------------------------------------
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def confirmed(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {
        "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in match.split(".")),
        "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15,
    }[kind]()


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if confirmed(kind, m.group())]
    return ",".join(f"{[*PLAIN][k]}:{a}:{b}" for a, k, b in sorted(found))


def card(r):
    start = [r.randint(0, 9) for _ in range(15)]
    return next(s for c in range(10) if luhn(s := "".join(map(str, [*start, c]))))


def mail_rows(seed=3):
    """Texts of three habits with identifiers that an expression finds, and some that none does; and clean ones."""
    r = random.Random(seed)
    words = "the a of call me at on mail write to now please phone is card seven".split()
    rows, hidden = [], {}
    for i in range(300):
        w = [r.choice(words) for _ in range(30)]
        known = r.random() < 0.85
        if i % 4 == 0:
            s = f"{r.choice('abcdef')}{i}@x{r.randint(1, 50)}.org" if known else f"u{i + 1000}(at)host{r.randint(1, 9)}"
            w[10:10] = ["write", "to", "ME", "at", s]
        elif i % 4 == 1:
            s = card(r) if known else f"card-no-{i}-{r.randint(10**7, 10**8)}"
            w[10:10] = ["my", "Card", "number:", s]
        elif i % 4 == 2:
            s = f"+1 ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)}" if known else f"({r.randint(100, 999)})555-{i + 1000}"
            w[10:10] = ["call", "home", "at", s]
        text = " ".join(w)
        if i % 4 < 3 and not known:
            core = s.strip("()") if not s.startswith("(") else s[1:]
            hidden[i] = ("email card phone".split()[i % 4], text.index(core), text.index(core) + len(core))
        rows.append((i, text))
    return rows, hidden


def test_learned_spans(spark):
    rows, hidden = mail_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in private_data.extract(df).collect()}
    assert hidden and len(got) == 300
    for i, text in rows:
        base = base_spans(text)
        want = ",".join(x for x in (base, ":".join(map(str, hidden[i])) if i in hidden else "") if x)
        assert got[i].spans == want and got[i].n_learned == (i in hidden)
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    trusted = {r.pattern: r for r in private_data.patterns(df).collect()}
    assert trusted["2 me at"].email > 0.7 and trusted["2 card number:"].card > 0.7 and trusted["2 home at"].phone > 0.7
    assert not [p for p in trusted if p.startswith("2 the")]


def test_learning_takes_rounds(spark):
    """Strings that a first pattern makes likely are what makes a second one trusted."""
    r = random.Random(9)
    rows = [(k, f"reach us: a{k}@b.org thanks") for k in range(40)]
    rows += [(100 + k, f"reach us: user-{k}-{r.randint(100, 999)} thanks") for k in range(8)]
    known = [t.split()[2] for _, t in rows[40:]]
    rows += [(200 + k, f"kindly ask for {s} soon") for k, s in enumerate(known)]
    rows += [(300, "kindly ask for nobody-99-111 soon")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    late = {r.doc_id: r.n_learned for r in private_data.extract(df).collect()}
    early = {r.doc_id: r.n_learned for r in private_data.extract(df, rounds=1).collect()}
    assert late[100] == early[100] == 1 and late[300] == 1 and early[300] == 0


def odd_texts():
    r = random.Random(4)
    alphabet = "0123456789 .-+()@aZ_%\n\té"
    rows = [(k, "".join(r.choice(alphabet) for _ in range(r.randint(0, 120)))) for k in range(300)]
    rows += [(1000, None), (1000, ""), (None, "x@y.z 1.2.3.4"), (None, None), (5, "x@y.z 1.2.3.4"), (5, "x@y.z 1.2.3.4")]
    rows += [(1301, "a" * 100_000), (1302, "1" * 100_000), (1303, "1 " * 50_000), (1304, "+1" * 30_000), (1305, "a." * 30_000 + "@" + "b." * 30_000 + "c"), (1306, "+1" + "(" * 50_000)]
    rows += [(1307, "a@b.c.@d.e 1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.255 \U0001f600 +1 (555) 123-4567 x@y.zz\x0b9")]
    return rows


def test_base_spans_of_odd_texts(spark):
    rows = odd_texts()
    want = {}
    for i, t in rows:
        want.setdefault(i, set()).add(hashlib.sha256(base_spans(t).encode()).hexdigest())
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, start int, spans string").repartition(3)
    got = private_data.extract(df).collect()
    assert len(got) == len(rows) and all(r.base_sha256 in want[r.doc_id] for r in got)
    assert all(r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_learned == len([x for x in r.spans.split(",") if x]) for r in got)
    assert private_data.extract(df.limit(0)).collect() == []


def test_personal_data_sql(spark):
    rows = mail_rows(8)[0] + [(i if i is None else i + 5000, t) for i, t in odd_texts() if not t or len(t) < 5000]
    assert same(private_data.extract(spark.createDataFrame(rows, "doc_id long, text string")), private_data.oracle(), rows)


def test_personal_data_stays_in_the_jvm(spark):
    df = private_data.extract(spark.createDataFrame(mail_rows()[0][:9], "doc_id long, text string"))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


# -- fill-in-the-middle ---------------------------------------------------------------
MIDDLES = [(k, t) for k, t in enumerate(["", None, "a", "é", "\U0001f600", "has <P> inside", "<S>", "x<M", "né\U0001f600 中文 <", "two words", " lead", "\n\n", "line\nline two\n\nend"])]
MIDDLES += [(100 + k, "".join(random.Random(k).choice("a é\U0001f600<P>SM\n") for _ in range(k))) for k in range(120)]
MIDDLES += [(None, "null id"), (7, "again"), (7, "again"), (900, "ab\U0001f600" * 40_000)]


def expected(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((a % (n + 1), b % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if d % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle(spark):
    df = spark.createDataFrame([(i, t, 1, "f") for i, t in MIDDLES], "doc_id long, text string, n int, form string").repartition(4)
    want = sorted(map(repr, (expected(i, t) for i, t in MIDDLES)))
    got = fill_middle.fill_in_middle(df)
    assert sorted(repr((r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got.collect()) == want
    assert {"psm", "spm", "plain"} == {r.form for r in got.collect()}
    back = fill_middle.restore(got).select("doc_id", "text")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.selectExpr("doc_id", "coalesce(text, '') AS text").collect()))
    digests = {r.output_sha256: r.restored_sha256 for r in fill_middle.fill_in_middle(df, digest=True).collect()}
    assert digests == {hashlib.sha256(expected(i, t)[4].encode()).hexdigest(): hashlib.sha256((t or "").encode()).hexdigest() for i, t in MIDDLES}
    assert fill_middle.fill_in_middle(df.limit(0)).collect() == []


def test_fill_in_middle_sql(spark):
    df = spark.createDataFrame(MIDDLES, "doc_id long, text string")
    assert same(fill_middle.fill_in_middle(df, digest=True), fill_middle.oracle(), MIDDLES)


def test_units():
    text = " two  words\n and\té\n"
    data = text.encode()
    for units, want in {"words": re.findall(r"\A\s+|\S+\s*", text), "lines": text.splitlines(True), "characters": list(text)}.items():
        ends = fill_middle.unit_ends(data, units)
        cuts = [0, *(fill_middle.ranked_bit(ends, k) + 1 for k in range(ends.bit_count()))]
        assert [data[a:b].decode() for a, b in zip(cuts, cuts[1:])] == want
    r = random.Random(1)
    for size in (1, 2, 63, 64, 65, 1000):
        mask = r.getrandbits(size) | 1
        places = [k for k in range(size) if mask >> k & 1]
        assert [fill_middle.ranked_bit(mask, k) for k in range(len(places))] == places
    with pytest.raises(IndexError):
        fill_middle.ranked_bit(5, 2)
    with pytest.raises(ValueError):
        fill_middle.unit_ends(b"x", "pages")


def test_marks_are_found_again():
    for text in ("<", "<<", "P>", "<S", "M><", "<P", "S><M"):
        for a in range(len(text) + 1):
            for b in range(len(text) + 1):
                n, before, inside, (p, m, s) = fill_middle.cut(text.encode(), a, b)
                assert n == len(text) and p + m + s == text.encode() and before + inside == max(a, b)
                assert fill_middle.restore_text(b"<P>" + p + b"<S>" + s + b"<M>" + m, "psm") == text.encode()
                assert fill_middle.restore_text(b"<S>" + s + b"<P>" + p + b"<M>" + m, "spm") == text.encode()


# -- robust outliers do not depend on the layout -----------------------------------------
def test_ranks_are_exact(spark):
    r = np.random.default_rng(2)
    values = np.concatenate([np.round(r.normal(size=900) * 3, 2), np.zeros(300), [1e12, -5.5, 1e-9]])
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 2.0)], "key string, v double").repartition(7)
    for share in (0.001, 0.5, 0.75, 1.0):
        got = {x.key: x["rank"] for x in quality._ranked(df, ["key"], F.col("v"), share, 2).collect()}
        units = np.sort(np.floor(np.clip(values, -quality.FAR, quality.FAR) * quality.UNIT).astype(np.int64))
        assert got == {"a": units[max(1, math.ceil(len(units) * share)) - 1], "b": 2 * quality.UNIT}


def test_estimates_are_the_same_for_any_layout(spark):
    x = (F.round(F.abs(F.randn(7)) * quality.GRID) / quality.GRID).alias("x0")
    more = [(F.round(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(9973)) / F.lit(500.0) * quality.GRID) / quality.GRID).alias(f"x{k}") for k in (1, 2, 3)]
    df = spark.range(200_000, numPartitions=3).select(F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("key"), x, *more)
    path = quality.materialise(df, "layout-test")
    found = [{r.key: (r.center, r.precision, r.settled) for r in quality.estimates(path.repartition(parts)).collect()} for parts in (1, 3, 17)]
    assert found[0] == found[1] == found[2] and {k: v[2] for k, v in found[0].items()} == {"a": True, "b": True}


def test_what_does_not_settle_is_marked(spark, monkeypatch):
    monkeypatch.setattr(quality, "SETTLED", -1.0)
    monkeypatch.setattr(quality, "STEPS", 2)
    rows = [(k, " ".join(f"w{j}" for j in range(30 + k)), "en", "s") for k in range(120)]
    got = quality.judge(spark.createDataFrame([*rows, (999, "few words", "en", "s")], "doc_id long, text string, lang string, source string")).collect()
    assert {r.settled for r in got if not r.base_failed} == {False} and len(got) == 121


# -- messages between blocks and ranges ----------------------------------------------------
def test_blocks_grow_with_ranges():
    from pairloom.llm import _shared

    rows = lambda size, ranges: size / _shared.block_size(ranges) * ranges
    assert _shared.block_size(200) == _shared.BLOCK_BYTES
    few, many = rows(2**40, 2048), rows(2**42, 8192)  # four times the texts and the ranges
    assert many == 4 * few
    assert _shared.block_size(10**6) == _shared.MOST_BLOCK_BYTES


def test_block_files_tell_texts_apart(tmp_path):
    """Another attempt with other rows writes another file, with the same rows the same one."""
    import pyarrow as pa

    from pairloom.llm import ngram_lm

    table = lambda *rows: pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": [t for _, t in rows]})
    digests = {ngram_lm._digest(t) for t in (table((1, "a b")), table((1, "a"), (None, " b")), table((2, "a b")), table((1, "a b"), (1, "a b")))}
    assert len(digests) == 4 and ngram_lm._digest(table((1, "a b"))) in digests
    ngram_lm._write_once(ngram_lm._file(f"file://{tmp_path}", b"\x00" * 16), table((1, "a")))
    assert [p.name for p in tmp_path.iterdir()] == ["00" * 16]


# -- long words -----------------------------------------------------------------------------
def test_long_words_are_walked():
    """A megabyte without white space takes a second or so; the walk gives what the rounds give; the table stays small."""
    import time

    from pairloom.llm import token_counts

    public = pytest.importorskip("public_tokenizers")
    counts = token_counts.Counts(public.path("word_bpe_49k.json"))
    r = random.Random(7)
    words = ["".join(r.choice("aeiouxyzé+/09") for _ in range(n)).encode() for n in (0, 1, 5, 63, 64, 255, 256, 257, 258, 2000)]
    auto = counts.automaton
    assert [auto.walk(w) for w in words] == auto._rounds(words).tolist() == auto.count(words).tolist()
    text = "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=1_000_000))
    counts.of(["warm " + "x" * 300])
    began = time.process_time()
    n, pieces = counts.of([f"{text} short {text}"])
    assert time.process_time() - began < 5 and n == [3] and pieces[0] == 2 * auto.walk(text.encode()) + auto.walk(b"short")
    assert set(map(len, counts.memo)) <= set(range(token_counts.KEPT + 1)) and b"short" in counts.memo
    small = token_counts.LongestMatch([(1,), (2,), (1, 2), (token_counts.END,)])
    assert small.walk(bytes([1, 2, 9])) == 1 == small._rounds([bytes([1, 2, 9])])[0]
