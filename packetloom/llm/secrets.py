"""Secret scans: fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

All of it is DataFrame and SQL functions; no Python runs on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from packetloom.llm.common import join_lookup, numbered, query, staged, table

#: Kinds of spans in the order in which ties of position are listed.
KINDS = ["assign", "access", "hex", "random"]
#: Case of the keywords is spelled out: ASCII letters only, in any regular-expression dialect.
_any_case = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
ASSIGN = (f"({'|'.join(map(_any_case, ['password', 'passwd', 'secret', 'token']))}|{_any_case('api')}_?{_any_case('key')})"
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: A run that is too short can't hide a longer one inside it, so the least lengths may stand in these two patterns.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Alphabets from the narrowest to the widest; a token's encoding is the first that covers it.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = {
    "decimal": DIGITS, "hex": DIGITS + LOWER[:6], "hex-upper": DIGITS + UPPER[:6], "lower": LOWER, "upper": UPPER, "base32": UPPER + DIGITS[2:8], "lower-digit": LOWER + DIGITS,
    "upper-digit": UPPER + DIGITS, "letters": UPPER + LOWER, "base62": UPPER + LOWER + DIGITS, "base64": UPPER + LOWER + DIGITS + "+/", "base64url": UPPER + LOWER + DIGITS + "-_",
}
#: Elements of a block of running results, and code points of a piece of a text.
BLOCK, PIECE = 64, 1024
#: Lengths from which a new stratum starts.
BANDS = [20, 24, 32, 48, 96, 256]
#: Structure that a token must be shown not to have: two symbols being equal with at least this probability (letters of a
#: language come to 0.06 and more) or so many times as often as in random text; this share of the runs missing; this
#: correlation of neighbours.
EQUAL, REPEATS, FEWER_RUNS, CORRELATION = 0.04, 1.6, 0.4, 0.5
#: Standard errors from uniform random text at which a token fails the battery: repeated symbols (a skewed statistic), too few
#: or too many runs, dependent neighbours.
UNEVEN, ODD_RUNS, DEPENDENT = 4.5, 3.5, 3.5
#: Letters of written language in per mille (means over English, German, French and Spanish, five at least).
LETTERS = dict(zip(LOWER, [89, 15, 31, 44, 153, 13, 17, 28, 72, 5, 7, 47, 25, 79, 60, 22, 6, 65, 72, 71, 40, 11, 11, 5, 9, 7], strict=True))
VOWELS = "aeiouy"
#: How structured tokens go from one class of symbols to the next (lower case, upper case, digits, signs): words and camel
#: case; capitals; dates, versions and numbers; words with short numbers.
STYLES = [[[.88, .04, .02, .06], [.60, .33, .03, .04], [.06, .06, .70, .18], [.65, .15, .15, .05]],
          [[.60, .20, .05, .15], [.02, .86, .04, .08], [.05, .10, .75, .10], [.05, .75, .15, .05]],
          [[.60, .05, .25, .10], [.05, .60, .25, .10], [.025, .025, .80, .15], [.10, .05, .80, .05]],
          [[.80, .03, .12, .05], [.03, .80, .12, .05], [.27, .27, .36, .10], [.40, .25, .30, .05]]]


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _before(values: str, join: str = "{0} + {1}", levels: int = 2) -> str:
    """Array: for each of ``values`` (bigint) what ``join`` makes of 0 and all values before it, in about linear time.

    Appending to an array copies it, so results are made in blocks, those of the blocks in blocks again.
    """
    step = join.format("a.so_far", "x")
    plain = lambda of: f"aggregate({of}, struct(0L as so_far, cast(array() as array<bigint>) as out), (a, x) -> struct({step} as so_far, concat(a.out, array(a.so_far)) as out)).out"
    if not levels:
        return plain(values)
    v, b = f"v{levels}", f"b{levels}"
    blocks = f"transform(sequence(0, (size({v}) - 1) div {BLOCK}), k -> slice({v}, cast(k * {BLOCK} + 1 as int), {BLOCK}))"
    totals = f"transform({b}, y -> aggregate(y, 0L, (s, x) -> {join.format('s', 'x')}))"
    whole = f"flatten(zip_with({b}, {_before(totals, join, levels - 1)}, (y, t) -> transform({plain('y')}, x -> {join.format('t', 'x')})))"
    return _let(v, values, _let(b, blocks, whole))


def _pieces(text: str) -> str:
    """The text in pieces of ``PIECE`` code points: a place in a text is found by reading it from its beginning, one in a piece is near."""
    return f"regexp_extract_all({text}, '(?s).{{1,{PIECE}}}', 0)"


def _cut(pieces: str, start: str, end: str) -> str:
    """Code points ``start`` to ``end`` (exclusive) of a text in pieces."""
    low = f"greatest({start} - k * {PIECE}, 0)"
    part = f"substring({pieces}[k], cast({low} + 1 as int), cast(least({end} - k * {PIECE}, {PIECE}) - {low} as int))"
    return f"if({end} > {start}, array_join(transform(sequence({start} div {PIECE}, ({end} - 1) div {PIECE}), k -> {part}), ''), '')"


def found(pattern: str, text: str = "text", group: int = 0) -> Column:
    """Array of ``start, end, part`` of all leftmost non-overlapping matches, in code points; ``part`` is the given group.

    Functions that list matches don't tell where they are; the pieces between them do.
    """
    r = _quoted(pattern)
    parts = f"zip_with(regexp_extract_all({text}, {r}, 0), regexp_extract_all({text}, {r}, {group}), (m, g) -> struct(length(m) as size, g as part))"
    hits = f"zip_with(slice(split({text}, {r}, -1), 1, size(parts)), parts, (p, m) -> struct(length(p) as gap, m.size as size, m.part as part))"
    ends = _before("transform(hits, h -> cast(h.gap + h.size as bigint))")
    placed = f"zip_with(hits, {ends}, (h, e) -> struct(cast(e + h.gap as int) as start, cast(e + h.gap + h.size as int) as end, h.part as part))"
    return F.expr(f"case when {text} rlike {r} then {_let('parts', parts, _let('hits', hits, placed))} else cast(array() as array<struct<start:int,end:int,part:string>>) end")


def _spans(column: str, kind: str, keep: str = "true") -> str:
    return f"transform(filter({column}, x -> {keep}), x -> struct(x.start as start, {KINDS.index(kind)} as kind, x.end as end))"


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, doc_id, base`` (spans of the fixed patterns) and ``tokens`` (runs that may be encoded secrets), by input row."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("row", "doc_id", "text", found(ASSIGN, group=2).alias("assign"), found(ACCESS).alias("access"), found(HEX).alias("hex"), found(TOKEN).alias("tokens"))
    base = f"sort_array(concat({_spans('assign', 'assign', 'length(x.part) >= 6')}, {_spans('access', 'access')}, {_spans('hex', 'hex')}))"
    # what base spans leave of a token: the pieces before, between and behind them that are long enough by themselves. Borders in
    # order, each with its step of 1024 x (tokens begun) + (in a token) - 4 x (base spans around)
    steps = [("tokens", "start", 1025), ("tokens", "end", -1), ("base", "start", -4), ("base", "end", 4)]
    borders = f"sort_array(concat({', '.join(f'transform({of}, x -> struct(x.{side} as at, {step}L as step))' for of, side, step in steps)}))"
    open_ = f"zip_with(borders, {_before('transform(borders, x -> x.step)')}, (x, s) -> s + x.step + 32)"
    between = "filter(transform(borders, (x, i) -> struct(x.at as start, get(borders, i + 1).at as end, open[i] as open)), x -> x.open % 1024 = 33 and x.end - x.start >= 20)"
    bare = f"transform({between}, x -> struct(x.start as start, x.end as end, {_cut('pieces', 'x.start', 'x.end')} as part))"
    free = _let("borders", borders, _let("open", open_, _let("pieces", _pieces("text"), f"filter({bare}, x -> length(rtrim('=', x.part)) >= 20)")))
    return rows.withColumn("base", F.expr(base)).select("row", "doc_id", "base", F.expr(f"if(size(base) = 0 or size(tokens) = 0, tokens, {free})").alias("tokens"))


def language() -> tuple[str, list[list[float]], list[float]]:
    """Symbols of all encodings, and for each style the log-probability of every symbol after every other (row by row, without
    the share of classes that an encoding lacks), and of a first symbol inside its class.

    A letter after a letter is a vowel or a consonant as in language, whatever its case; letters have the frequencies of
    language, digits and signs are even.
    """
    symbols = LOWER + UPPER + DIGITS + "+/-_"
    kind = [0] * 26 + [1] * 26 + [2] * 10 + [3] * 4
    vowel = [c.lower() in VOWELS for c in symbols]
    mass = {v: sum(n for c, n in LETTERS.items() if (c in VOWELS) == v) for v in (True, False)}
    share = {(True, True): 0.18, (True, False): 0.82, (False, True): 0.58, (False, False): 0.42}

    def inside(x: int | None, y: int) -> float:
        if kind[y] > 1:
            return 1 / (10 if kind[y] == 2 else 4)
        turn = share[vowel[x], vowel[y]] if x is not None and kind[x] < 2 else 0.4 if vowel[y] else 0.6
        return turn * LETTERS[symbols[y].lower()] / mass[vowel[y]]

    every = range(len(symbols))
    return symbols, [[math.log(style[kind[x]][kind[y]] * inside(x, y)) for x in every for y in every] for style in STYLES], [math.log(inside(None, y)) for y in every]


def _numbers(values: list[float]) -> str:
    return f"array({', '.join(f'{v:.6f}D' for v in values)})"


def structured(rows: DataFrame) -> DataFrame:
    """Adds ``p_language`` to tokens (``body, alphabet, size``): the largest likelihood of a style over that of uniform text.

    Were the token written in a style, such a ratio would be at most ``p`` with probability ``p`` at most, so it is a p-value
    for each of them, at any length. An encoding that lacks classes of symbols takes their share from each step.
    """
    symbols, steps, first = language()
    rows = rows.withColumn("sym", F.expr(f"transform(split(body, ''), c -> greatest(instr('{symbols}', c) - 1, 0))"))
    classes = [F.expr(f"cast(translate(alphabet, '{part}', '') <> alphabet as int)") for part in (LOWER, UPPER, DIGITS, "+/-_")]
    rows = rows.withColumn("has", F.array(*classes))
    lost = ["array({})".format(", ".join("ln(" + " + ".join(f"{v}D * has[{i}]" for i, v in enumerate(row)) + " + 1e-9D)" for row in style)) for style in STYLES]
    rows = rows.withColumns({f"lost{k}": F.expr(x) for k, x in enumerate(lost)})
    rows = rows.withColumn("here", F.expr("transform(sym, v -> case when v < 26 then 0 when v < 52 then 1 when v < 62 then 2 else 3 end)"))
    start = f"{_numbers(first)}[sym[0]] - ln(has[0] + has[1] + has[2] + has[3] + 0D)"
    to_next = "zip_with(slice(sym, 1, size(sym) - 1), slice(sym, 2, size(sym) - 1), (x, y) -> x * {n} + y)"
    rows = rows.withColumn("moves", F.expr(to_next.format(n=len(symbols))))
    score = [F.expr(f"{start} + aggregate(moves, 0D, (s, v) -> s + {_numbers(step)}[v]) - aggregate(slice(here, 1, size(here) - 1), 0D, (s, v) -> s + lost{k}[v])") for k, step in enumerate(steps)]
    best = F.greatest(*score) + F.col("n") * F.log(F.col("size").cast("double"))
    return rows.withColumn("p_language", F.exp(F.least(best, F.lit(0.0)))).drop("sym", "has", "here", "moves", *[f"lost{k}" for k in range(len(STYLES))])


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a normal variable (a five-term rational approximation, good to 1e-7 and in relative terms far out)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * series
    return F.when(z >= 0, tail).otherwise(1 - tail)


def randomness(tokens: DataFrame) -> DataFrame:
    """Adds ``encoding, size, p_uniform, p_runs, p_serial, p_language, p`` to tokens (``part``).

    Each p-value is for the hypothesis that the token *is* structured. Three are at the edge set by the constants above:
    symbols that repeat as in language (chi-squared against the encoding's uniform alphabet), long runs on one side of the
    alphabet's middle (runs test), and neighbours that depend on one another (lag-one serial correlation). Random text has
    small ones in all three, but a short token can't, whatever it holds. ``p_language`` weighs the symbols and their
    neighbours one by one and has them from 20 characters on.

    ``p`` is ``p_language`` where the three statistics agree with uniform random text (``UNEVEN, ODD_RUNS, DEPENDENT``), and 1
    where one doesn't: counters, alphabets and repeats. Digits alone have no language; for them the largest of the three
    p-values counts.
    """
    body = F.regexp_replace("part", "=+$", "")
    pick = F.lit(None).cast("string")
    for name, alphabet in reversed(ALPHABETS.items()):
        pick = F.when(F.length(F.translate(body, alphabet, "")) == 0, F.lit(name)).otherwise(pick)
    of = F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair])
    rows = tokens.withColumn("body", body).withColumn("encoding", F.coalesce(pick, F.lit("base64"))).withColumn("alphabet", of[F.col("encoding")])
    rows = rows.withColumn("size", F.length("alphabet")).withColumn("n", F.length("body").cast("double"))
    rows = rows.withColumn("at", F.expr("transform(split(body, ''), c -> greatest(instr(alphabet, c) - 1, 0))")).filter("n >= 2")
    # sum of squared counts: per alphabet symbol, the length lost by removing it
    rows = rows.withColumn("squares", F.expr("aggregate(array_distinct(at), 0D, (s, v) -> s + power(size(filter(at, w -> w = v)), 2))"))
    a, n = F.col("size"), F.col("n")
    chi = a / n * F.col("squares") - n
    beyond = (n - 1) * (F.greatest(F.lit(REPEATS), EQUAL * a) - 1)  # the noncentrality of the edge
    rows = rows.withColumn("p_uniform", upper_tail((a - 1 + beyond - chi) / F.sqrt(2 * (a - 1) + 4 * beyond)))
    rows = rows.withColumn("high", F.expr("transform(at, v -> v >= size / 2)")).withColumn("n1", F.expr("cast(size(filter(high, h -> h)) as double)"))
    rows = rows.withColumn("runs", F.expr("1D + size(filter(zip_with(slice(high, 1, size(high) - 1), slice(high, 2, size(high) - 1), (x, y) -> x <> y), d -> d))"))
    mean = 2 * F.col("n1") * (n - F.col("n1")) / n + 1
    spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
    rows = rows.withColumn("p_runs", F.when((F.col("n1") > 0) & (F.col("n1") < n), upper_tail((F.col("runs") - (1 - FEWER_RUNS) * mean) / spread)).otherwise(1.0))
    rows = rows.withColumn("m", F.expr("aggregate(at, 0D, (s, v) -> s + v) / n"))
    rows = rows.withColumn("var", F.expr("aggregate(at, 0D, (s, v) -> s + (v - m) * (v - m))"))
    rows = rows.withColumn("cov", F.expr("aggregate(zip_with(slice(at, 1, size(at) - 1), slice(at, 2, size(at) - 1), (x, y) -> (x - m) * (y - m)), 0D, (s, v) -> s + v)"))
    r = F.abs(F.col("cov") / F.col("var"))
    rows = rows.withColumn("p_serial", F.when(F.col("var") > 0, upper_tail((CORRELATION - r) * F.sqrt(n))).otherwise(1.0))
    fails = (((chi - (a - 1)) / F.sqrt(2 * (a - 1)) > UNEVEN) | (F.abs(F.col("runs") - mean) / spread > ODD_RUNS) | (F.col("var") == 0) | (r * F.sqrt(n) > DEPENDENT))
    rows = structured(rows).withColumn("p", F.when(F.col("encoding") == "decimal", F.greatest("p_uniform", "p_runs", "p_serial"))
                                       .when(F.coalesce(fails, F.lit(True)), 1.0).otherwise(F.col("p_language")))
    return rows.drop("body", "alphabet", "at", "squares", "high", "n1", "runs", "m", "var", "cov", "n")


def discoveries(tokens: DataFrame, rate: float) -> DataFrame:
    """The tokens called random at a false-discovery rate of ``rate`` in each stratum of encoding and length.

    Benjamini-Hochberg on p-values rounded up to a fixed grid of 64 x 8 steps, so a stratum, however large, is a small table of
    counts. Strata by length keep the many short tokens from paying for, or hiding behind, the few long ones.
    """
    length = F.col("end") - F.col("start")
    band = sum((length >= b).cast("int") for b in BANDS)
    step = F.least(F.lit(511), F.floor(-F.log2(F.greatest(F.col("p"), F.lit(1e-60))) * 8)).cast("int")
    rows = staged(tokens.withColumn("stratum", F.concat_ws("/", "encoding", band)).withColumn("step", step), "tokens")
    counts = rows.groupBy("stratum", "step").agg(F.count("*").alias("n"))
    own = Window.partitionBy("stratum")
    down = own.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("so_far", F.sum("n").over(down)).withColumn("all", F.sum("n").over(own))
    cut = ranked.filter(F.col("all") * F.pow(F.lit(2.0), -F.col("step") / 8) <= rate * F.col("so_far")).groupBy("stratum").agg(F.min("step").alias("cut"))
    return join_lookup(rows, staged(cut, "cuts"), ["stratum"]).filter("step >= cut")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.01) -> DataFrame:
    """``row, doc_id, base, spans`` per input row: arrays of ``start, kind, end`` in code points, ordered by start, then kind.

    ``base`` has the spans of the fixed patterns. ``spans`` adds runs of encoded characters, clear of base spans, that the
    randomness battery tells from language and counters at a false-discovery rate of ``rate`` over the whole table.

    A null or empty text has no spans; one with very many costs time in proportion to them. Null or repeated ids are separate rows. ``row`` numbers the input rows, alike on every
    read of a written table. Other columns play no part.
    """
    scanned = staged(scan(docs, id_col, text_col), "scanned")
    tokens = scanned.select("row", F.explode("tokens").alias("t")).select("row", "t.*")
    random = discoveries(randomness(tokens), rate)
    extra = random.groupBy("row").agg(F.collect_list(F.struct("start", F.lit(KINDS.index("random")).alias("kind"), "end")).alias("extra"))
    both = scanned.drop("tokens").join(extra, "row", "left")
    return both.withColumn("spans", F.expr("if(extra is null, base, sort_array(concat(base, extra)))")).drop("extra")


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = None, **options) -> DataFrame:
    """``docs`` with every secret span of the text replaced by ``[SECRET]``; overlapping spans give one mark. Every row stays.

    ``length_col`` names a column that holds the text's code points and is set anew where the text changes. Rows keep their
    numbers on every read (see ``numbered``). Null and empty texts stay as they are; an empty table gives an empty one.
    """
    held, own = numbered(docs, "secrets"), F.col("_d").getField
    found_ = find_secrets(held.select("_row", own(text_col).alias("_text")), "_row", "_text", **options).filter("size(spans) > 0")
    marks = found_.select(F.col("doc_id").alias("_row"), F.col("spans").alias("_spans"))
    numbered_rows = held.withColumn("_old", own(text_col).cast("string")).join(marks, "_row", "left")
    before = _before("transform(_spans, x -> cast(x.end as bigint))", "greatest({0}, {1})")
    marks_ = f"filter(zip_with(_spans, {before}, (x, e) -> struct(e as clear, x.start as start)), x -> x.start >= x.clear)"
    last = "array_max(transform(_spans, x -> x.end))"
    kept = f"concat(array_join(transform({marks_}, x -> concat({_cut('pieces', 'x.clear', 'x.start')}, '[SECRET]')), ''), {_cut('pieces', last, 'length(_old)')})"
    new = _let("pieces", _pieces("_old"), kept)
    out = numbered_rows.withColumn("_new", F.expr(f"if(_spans is null, _old, {new})"))
    replaced = {text_col: F.col("_new")} | ({length_col: F.when(F.col("_spans").isNull(), own(length_col)).otherwise(F.length("_new"))} if length_col else {})
    return out.select(*[replaced.get(c, own(c)).alias(c) for c in docs.columns])


def listed(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = f"array({', '.join(repr(k) for k in KINDS)})"
    return F.expr(f"array_join(transform({spans}, x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ',')")


@query("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    spans = find_secrets(table(spark, d, "documents"))
    n = lambda kind: F.expr(f"cast(size(filter(base, x -> x.kind = {KINDS.index(kind)})) as bigint)").alias(f"n_{kind}")
    return spans.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
