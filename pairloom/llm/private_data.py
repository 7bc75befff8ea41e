"""Operator 12: personal data by bootstrapped contextual extraction, in SQL functions only.

* Seeds: addresses, numbers and the like that four expressions find and a rule
  confirms (parts of an IP address, the Luhn sum of a card, digits of a phone).
* Candidates: the other words that have a digit or an @ and could be an
  identifier (``LENGTHS`` characters once punctuation around them is gone).
* Patterns: the two words before a seed or candidate, and the word before with
  the word after.  Patterns and the distinct strings that stand in them make a
  graph, which copies of a text do not weigh down.
* Rounds: a pattern's confidence in a kind is the sum of its strings' scores
  for that kind, over the number of its strings and one more, so strings that
  nothing is known about count against it.  It is trusted from ``SUPPORT``
  strings of the kind and a confidence of ``TRUST`` on.  The score of a string
  that is no seed is the chance that not all of its trusted patterns are wrong.
* After the last round a candidate in a trusted pattern becomes a span of the
  kind that its patterns make likeliest.  Base spans always stay.

Scan of texts: one pass, no shuffle, and nothing but texts with a digit or an @
is looked at further.  All expressions are possessive and begin only where a
match can begin, so they take time in proportion to any text.  What moves are
spans with their context (``CONTEXT`` characters at most), distinct by text
before they meet; the hottest pattern or text is summed in every task first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm._shared import discard, materialise

BLANK = r"\x20\x09-\x0D"
#: kind -> expression; each finds what the plain expression of its kind finds, leftmost and without overlaps
KINDS = {
    # within a run of name characters only its begin, or where the match before ended, can begin a match
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A word with a digit or an @.
WORD = rf"(?<![^{BLANK}])[^{BLANK}0-9@]*+[0-9@][^{BLANK}]*+"
PUNCTUATION = "!\"#$%&'()*,-./:;<=>?[\\]^_`{|}~"
#: Characters of a candidate.
LENGTHS = (6, 64)
#: Characters of text before and after, as far as the expression's next match, that context words are taken from.
CONTEXT = 96
SUPPORT, TRUST, ROUNDS = 5, 0.7, 3
#: Digits that confidences are rounded to, so that the order of sums decides nothing.
DIGITS = 9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPAN = "array<struct<kind:int,j:int,gap:int,size:int,counts:boolean,string:string,before:string,after:string>>"


def _luhn(digits: Column) -> Column:
    """Whether the digits, the second from the right and every other doubled, sum to a multiple of ten."""
    value = lambda d, k: F.when(k % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, k: value(d.cast("int"), k))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(r"\A(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|\z)){4}\z")
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)


def _lowered(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def _scanned(docs: DataFrame) -> DataFrame:
    """doc_id, digest (null where no span can be), spans: everything found, with lengths of the gaps before it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("some", F.col("text").rlike("[0-9@]"))
    expressions = [*KINDS.values(), WORD]
    found = [F.when(F.col("some"), F.regexp_extract_all("text", F.lit(e), F.lit(0))).alias(f"m{k}") for k, e in enumerate(expressions)]
    gaps = [F.when(F.col("some"), F.split("text", e, -1)).alias(f"g{k}") for k, e in enumerate(expressions)]
    cut = rows.select("doc_id", F.when(F.col("some"), F.sha2("text", 256)).alias("digest"), *found, *gaps)

    def spans(k: int) -> Column:
        gap = lambda j: F.get(F.col(f"g{k}"), j)

        def one(m: Column, j: Column) -> Column:
            kind = [*KINDS, None][k]
            if kind is None:
                core = F.btrim(m, F.lit(PUNCTUATION))
                lead = F.length(m) - F.length(F.ltrim(m, F.lit(PUNCTUATION)))
                counts = (F.length(core) >= LENGTHS[0]) & (F.length(core) <= LENGTHS[1]) & core.rlike("[0-9@]")
                string = F.when(counts, F.concat(F.lpad(lead.cast("string"), 10, "0"), core))
            else:
                counts = _confirmed(kind, m)
                string = F.when(counts, m)
            return F.struct(
                F.lit(k).alias("kind"), j.alias("j"), F.length(gap(j)).alias("gap"), F.length(m).alias("size"), counts.alias("counts"), string.alias("string"),
                F.when(counts, F.right(gap(j), F.lit(CONTEXT))).alias("before"), F.when(counts, F.left(gap(j + 1), F.lit(CONTEXT))).alias("after"),
            )

        return F.transform(f"m{k}", one)

    return cut.select("doc_id", "digest", F.concat(*(spans(k).cast(_SPAN) for k in range(len(expressions)))).alias("spans"))


def _placed(scanned: DataFrame) -> DataFrame:
    """digest, kind, start, stop, string, two, around: confirmed spans and candidates that overlap none, once for each text."""
    rows = scanned.where(F.col("digest").isNotNull()).select("digest", F.explode("spans").alias("s")).select("digest", "s.*").distinct()
    of_kind = Window.partitionBy("digest", "kind").orderBy("j")
    rows = rows.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(of_kind).cast("long")).withColumn("start", F.col("stop") - F.col("size"))
    rows = rows.where("counts")
    word = F.col("kind") == len(KINDS)
    lead = F.when(word, F.substring("string", 1, 10).cast("long")).otherwise(0)
    core = F.when(word, F.expr("substring(string, 11)")).otherwise(F.col("string"))
    # the whole word must be free of base spans; of the words of one text none overlap
    rising = Window.partitionBy("digest").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    falling = Window.partitionBy("digest").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends, begins = F.max(F.when(~word, F.col("stop"))).over(rising), F.min(F.when(~word, F.col("start"))).over(falling)
    free = F.coalesce(ends <= F.col("start"), F.lit(True)) & F.coalesce(begins >= F.col("stop"), F.lit(True))
    rows = rows.withColumn("free", free).where(~word | F.col("free"))
    before, after = _lowered(F.col("before")), _lowered(F.col("after"))
    last = rf"[^{BLANK}]+(?=[{BLANK}]*\z)"
    two = F.regexp_extract(before, rf"[^{BLANK}]+[{BLANK}]+{last}", 0)
    one, following = F.regexp_extract(before, last, 0), F.regexp_extract(after, rf"\A[{BLANK}]*([^{BLANK}]+)", 1)
    pair = F.regexp_replace(two, rf"[{BLANK}]+", " ")
    return rows.select(
        "digest", "kind", (F.col("start") + lead).alias("start"), F.when(word, F.col("start") + lead + F.length(core)).otherwise(F.col("stop")).alias("stop"),
        _lowered(core).alias("string"), F.when(pair != "", F.concat(F.lit("2 "), pair)).alias("two"),
        F.when((one != "") & (following != ""), F.concat(F.lit("1 "), one, F.lit(" "), following)).alias("around"),
    )


def _patterns(column: str = "pattern") -> Column:
    return F.explode(F.array_compact(F.array("two", "around"))).alias(column)


def _score(k: int) -> str:
    return f"s{k}"


def _trusted(graph: DataFrame, scores: DataFrame, support: int, trust: float) -> DataFrame:
    """pattern, c0 ..: confidence in each kind, 0 where it is not trusted; patterns trusted in none are left out."""
    sums = graph.select("pattern", "string").join(scores, "string").groupBy("pattern").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.sum(_score(k)).alias(f"t{k}") for k in range(len(KINDS))),
        *(F.sum((F.col(_score(k)) >= trust).cast("int")).alias(f"m{k}") for k in range(len(KINDS))),
    )
    share = lambda k: F.round(F.col(f"t{k}") / (F.col("n") + 1), DIGITS)
    kept = [F.when((F.col(f"m{k}") >= support) & (share(k) >= trust), share(k)).otherwise(0.0).alias(f"c{k}") for k in range(len(KINDS))]
    return sums.select("pattern", *kept).where(F.greatest(*(F.col(f"c{k}") for k in range(len(KINDS)))) > 0)


def _doubt(k: int) -> Column:
    """The chance that all patterns are right in not naming kind k, as an aggregate."""
    return F.exp(F.sum(F.log(1 - F.coalesce(F.col(f"c{k}"), F.lit(0.0)))))


def _learned(placed: DataFrame, support: int, trust: float, rounds: int) -> DataFrame:
    seeds = [F.max((F.col("kind") == k).cast("double")).alias(_score(k)) for k in range(len(KINDS))]
    edges = placed.select("kind", "string", _patterns()).groupBy("pattern", "string").agg(*seeds)
    # a pattern with fewer strings can never be trusted
    enough = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support).select("pattern")
    graph = materialise(edges.join(enough, "pattern", "left_semi"), "patterns")
    own = graph.groupBy("string").agg(*(F.max(_score(k)).alias(_score(k)) for k in range(len(KINDS))))
    scores = own
    for r in range(rounds):
        found = materialise(_trusted(graph, scores, support, trust), "trusted")
        if r < rounds - 1:
            told = graph.select("pattern", "string").join(found, "pattern").groupBy("string").agg(*(F.round(1 - _doubt(k), DIGITS).alias(f"t{k}") for k in range(len(KINDS))))
            scores = own.join(told, "string", "left").select("string", *(F.greatest(_score(k), F.coalesce(f"t{k}", F.lit(0.0))).alias(_score(k)) for k in range(len(KINDS))))
    discard(graph)
    return found


def patterns(docs: DataFrame, support: int = SUPPORT, trust: float = TRUST, rounds: int = ROUNDS) -> DataFrame:
    """pattern, email, ip, card, phone: the trusted patterns and their confidence in each kind (0: none).

    A pattern is ``2 before last`` (the two words before) or ``1 last next``.
    """
    placed = materialise(_placed(_scanned(docs)), "spans")
    return _learned(placed, support, trust, rounds).select("pattern", *(F.col(f"c{k}").alias(name) for k, name in enumerate(KINDS)))


def find(docs: DataFrame, support: int = SUPPORT, trust: float = TRUST, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, spans: array of (start, kind, stop, learned) in order, for every row of ``docs`` (doc_id, text).

    ``kind`` is a number in ``KINDS``, positions are code points, ``learned``
    says that a pattern found the span.  A null text is empty and has no spans;
    null and repeated ids are kept, each row with the spans of its own text;
    equal texts have equal spans; an empty table gives no rows; other columns
    are not read.
    """
    scanned = materialise(_scanned(docs), "scanned")
    placed = materialise(_placed(scanned), "spans")
    trusted = _learned(placed, support, trust, rounds)
    words = placed.where(F.col("kind") == len(KINDS)).select("digest", "start", "stop", _patterns())
    told = words.join(trusted, "pattern").groupBy("digest", "start", "stop").agg(*(F.round(1 - _doubt(k), DIGITS).alias(f"t{k}") for k in range(len(KINDS))))
    best = F.array_max(F.array(*(F.struct(F.col(f"t{k}").alias("t"), F.lit(-k).alias("k")) for k in range(len(KINDS)))))
    learned = told.select("digest", "start", (-best["k"]).alias("kind"), "stop", F.lit(True).alias("learned"))
    base = placed.where(F.col("kind") < len(KINDS)).select("digest", "start", "kind", "stop", F.lit(False).alias("learned"))
    each = F.struct(F.col("start"), F.col("kind"), F.col("stop"), F.col("learned"))
    by_text = materialise(base.unionByName(learned).groupBy("digest").agg(F.array_sort(F.collect_list(each)).alias("spans")), "by-text")
    discard(placed, trusted)
    none = F.array().cast(by_text.schema["spans"].dataType)
    # most rows have nothing to look up: only the others meet their text's spans
    some = scanned.where(F.col("digest").isNotNull()).select("doc_id", "digest").join(by_text, "digest", "left")
    return scanned.where(F.col("digest").isNull()).select("doc_id", none.alias("spans")).unionByName(some.select("doc_id", F.coalesce("spans", none).alias("spans")))


def as_text(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def extract(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all, as text), n_learned; see ``find``."""
    base = F.filter("spans", lambda s: ~s["learned"])
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    learned = (F.size("spans") - F.size("base")).cast("long").alias("n_learned")
    return find(docs, **parameters).withColumn("base", base).select("doc_id", *counts, F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"), learned)


def oracle() -> str:
    """SQL of the query with its parameters: plain expressions on a linear engine, windows over texts, one table for each round."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    names, kinds = [*plain], range(len(plain))
    word, punctuation = rf"[^{BLANK}0-9@]*[0-9@][^{BLANK}]*", PUNCTUATION.replace("'", "''")
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(length({digits})), lambda k: CASE WHEN k % 2 = 0 THEN d(k) WHEN d(k) > 4 THEN 2 * d(k) - 9 ELSE 2 * d(k) END)) % 10 = 0"
    luhn = luhn.replace("d(k)", f"CAST({digits}[-1 - k] AS INT)")
    confirmed = {
        "email": "TRUE", "ip": "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || ltrim(p, '0') AS BIGINT) > 255)) = 0",
        "card": f"CASE WHEN length({digits}) BETWEEN 14 AND 19 THEN {luhn} ELSE FALSE END", "phone": f"length({digits}) BETWEEN 10 AND 15",
    }
    found = []
    for k, expression in enumerate([*plain.values(), word]):
        core = "m" if k < len(plain) else f"trim(m, '{punctuation}')"
        counts = confirmed[names[k]] if k < len(plain) else f"length({core}) BETWEEN {LENGTHS[0]} AND {LENGTHS[1]} AND regexp_matches({core}, '[0-9@]')"
        lead = "0" if k < len(plain) else f"length(m) - length(ltrim(m, '{punctuation}'))"
        found.append(
            f"SELECT t, {k} AS kind, sum(length(g) + length(m)) OVER (PARTITION BY t ORDER BY j) AS stop, length(m) AS size, {lead} AS lead, {core} AS core, {counts} AS counts, right(g, {CONTEXT}) AS before, left(h, {CONTEXT}) AS after "
            f"FROM (SELECT t, j, a[j] AS m, g[j] AS g, g[j + 1] AS h FROM (SELECT t, a, g, unnest(range(1, len(a) + 1)) AS j FROM (SELECT t, regexp_extract_all(t, '{expression}') AS a, string_split_regex(t, '{expression}') AS g FROM texts)))"
        )
    lowered = lambda c: f"translate({c}, '{UPPER}', '{LOWER}')"
    each = lambda f: ", ".join(f(k) for k in kinds)
    free = "(kind < 4 OR (coalesce(ends <= start, TRUE) AND coalesce(begins >= stop, TRUE)))"
    steps = [
        "docs AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS t FROM documents)",
        "texts AS (SELECT DISTINCT t FROM docs WHERE regexp_matches(t, '[0-9@]'))",
        f"found AS ({' UNION ALL '.join(found)})",
        "beside AS (SELECT *, max(CASE WHEN kind < 4 THEN stop END) OVER (PARTITION BY t ORDER BY start, kind ROWS UNBOUNDED PRECEDING) AS ends, min(CASE WHEN kind < 4 THEN start END) OVER (PARTITION BY t ORDER BY start DESC, kind DESC ROWS UNBOUNDED PRECEDING) AS begins FROM (SELECT *, stop - size AS start FROM found WHERE counts))",
        f"context AS (SELECT t, kind, start + lead AS start, CASE WHEN kind < 4 THEN stop ELSE start + lead + length(core) END AS stop, {lowered('core')} AS string, {lowered('before')} AS b, {lowered('after')} AS a FROM beside WHERE {free})",
        f"words AS (SELECT *, regexp_extract(b, '([^{BLANK}]+[{BLANK}]+[^{BLANK}]+)[{BLANK}]*$', 1) AS two, regexp_extract(b, '([^{BLANK}]+)[{BLANK}]*$', 1) AS one, regexp_extract(a, '^[{BLANK}]*([^{BLANK}]+)', 1) AS next FROM context)",
        f"placed AS (SELECT t, kind, start, stop, string, unnest(list_filter([CASE WHEN two <> '' THEN '2 ' || regexp_replace(two, '[{BLANK}]+', ' ', 'g') END, CASE WHEN one <> '' AND next <> '' THEN '1 ' || one || ' ' || next END], lambda p: p IS NOT NULL)) AS pattern FROM words)",
        f"edges AS (SELECT pattern, string, {each(lambda k: f'max(CASE WHEN kind = {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS s{k}')} FROM placed GROUP BY pattern, string)",
        f"graph AS (SELECT * FROM edges WHERE pattern IN (SELECT pattern FROM edges GROUP BY pattern HAVING count(*) >= {SUPPORT}))",
        f"scores0 AS (SELECT string, {each(lambda k: f'max(s{k}) AS s{k}')} FROM graph GROUP BY string)",
    ]
    doubt = lambda k: f"round(1 - exp(sum(ln(1 - c{k}))), {DIGITS})"
    for r in range(ROUNDS):
        share = lambda k: f"round(sum(s.s{k}) / (count(*) + 1), {DIGITS})"
        one = lambda k: f"CASE WHEN sum(CASE WHEN s.s{k} >= {TRUST}::DOUBLE THEN 1 ELSE 0 END) >= {SUPPORT} AND {share(k)} >= {TRUST}::DOUBLE THEN {share(k)} ELSE 0.0::DOUBLE END AS c{k}"
        steps.append(f"trusted{r} AS (SELECT * FROM (SELECT pattern, {each(one)} FROM graph g JOIN scores{r} s USING (string) GROUP BY pattern) WHERE greatest({each(lambda k: f'c{k}')}) > 0)")
        if r < ROUNDS - 1:
            steps.append(f"told{r} AS (SELECT string, {each(lambda k: f'{doubt(k)} AS t{k}')} FROM graph JOIN trusted{r} USING (pattern) GROUP BY string)")
            steps.append(f"scores{r + 1} AS (SELECT o.string, {each(lambda k: f'greatest(o.s{k}, coalesce(t{k}, 0)) AS s{k}')} FROM scores0 o LEFT JOIN told{r} USING (string))")
    likeliest = "CASE " + " ".join(f"WHEN t{k} = greatest({each(lambda k: f't{k}')}) THEN {k}" for k in kinds) + " END"
    steps += [
        f"learned AS (SELECT t, start, stop, {likeliest} AS kind, TRUE AS learned FROM (SELECT t, start, stop, {each(lambda k: f'{doubt(k)} AS t{k}')} FROM placed JOIN trusted{ROUNDS - 1} USING (pattern) WHERE kind = 4 GROUP BY t, start, stop))",
        "spans AS (SELECT t, start, stop, kind, learned FROM learned UNION ALL SELECT t, start, stop, kind, FALSE FROM context WHERE kind < 4)",
        f"named AS (SELECT *, {names!r}[kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS s FROM spans)",
        f"by_text AS (SELECT t, {each(lambda k: f'count(*) FILTER (kind = {k} AND NOT learned) AS n_{names[k]}')}, string_agg(s, ',' ORDER BY start, kind) FILTER (NOT learned) AS base, string_agg(s, ',' ORDER BY start, kind) AS spans, count(*) FILTER (learned) AS n_learned FROM named GROUP BY t)",
    ]
    return f"WITH {', '.join(steps)} SELECT doc_id, {each(lambda k: f'coalesce(n_{names[k]}, 0) AS n_{names[k]}')}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_learned, 0) AS n_learned FROM docs LEFT JOIN by_text USING (t)"
