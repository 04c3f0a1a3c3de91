"""Personal data: fixed patterns, and more spans by weak supervision.

Labelers (format, gazetteer, words before, words behind, neighbours) vote on candidate spans. Expectation-maximisation estimates
how reliable each labeler is, and its posteriors train the classifier that decides. Rows are handled by DataFrame and SQL
functions alone; the two fits work on counts of vote patterns, a table whose size the code bounds.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from packetloom.llm.common import query, staged, table

#: Kinds of spans in the order in which ties of position are listed; the first four have fixed rules.
KINDS = ["email", "ip", "card", "phone", "name", "number", "address", "iban"]
BASE = 4
LABELERS = ["format", "gazetteer", "before", "behind", "near"]

_LOCAL = "A-Za-z0-9._%+-"
#: What each kind looks like. Runs are possessive, and a run is entered at its first character only (or where the match before
#: ended): the same matches as without, but no text takes the square of its length, and none needs a deep stack.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a maximal run of digits with single separators; 14 digits or more are asked for here, since shorter runs fail as a whole
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # a form of address is no part of a name
    "name": r"(?<![\p{L}\p{N}])(?!(?:Dear|Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame)\x20)\p{Lu}\p{L}++(?:\x20\p{Lu}\.)?+(?:\x20\p{Lu}\p{L}++){1,2}+",
    "number": r"(?<![\p{L}0-9.,+@/-])\(?[0-9][0-9\x20()./-]{5,18}[0-9](?![\p{L}0-9@])",
    "address": r"(?<![\p{L}\p{N}])(?:[0-9]{1,5}\x20(?:\p{Lu}\p{L}++\x20){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square)|\p{Lu}\p{Ll}{1,30}(?:straße|strasse|weg|platz|gasse|allee)\x20[0-9]{1,4})(?![\p{L}\p{N}])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
IP_PARTS = rf"^{_PART}(?:\.{_PART}){{3}}$"

# Common given names; capitalised words that are no part of a person's name; countries of bank account numbers.
GIVEN = """James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen
Daniel Lisa Matthew Nancy Anthony Betty Mark Sandra Paul Margaret Steven Ashley Andrew Emily Kenneth Donna George Michelle Peter Laura Anna Maria Hans Klaus
Jürgen Stefan Andreas Martin Wolfgang Ursula Monika Petra Sabine Julia Katharina Jean Pierre Michel André Philippe Marie Nathalie Isabelle Sylvie Françoise
José Antonio Manuel Francisco Juan Carlos Javier Carmen Ana Isabel Dolores Pilar Lucía Elena Ali Mohammed Ahmed Fatima Wei Li Yuki Hiroshi Priya Raj""".split()
NOT_NAMES = """The This That These Those And But For From With When Where What Who How Why His Her Their Our Your January February March April May June July
August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday University Institute College School Department Ministry
Company Corporation Inc Ltd Street Road Avenue City County State United North South East West New Republic River Lake Chapter Section Table Figure Part Der Die Das Und
Les Des Une Est Los Las Una Del""".split()
IBAN_COUNTRIES = "AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split()
# Words before and behind a span that speak for and against it, by kind.
BEFORE = {"email": "e-?mail|contact|write to|correo|courriel", "ip": "ip|address|host|client|login from", "card": "card|visa|mastercard|karte|tarjeta|carte",
          "phone": "phone|tel|call|mobile|fax|telefon|móvil|téléphone", "name": "name|mr|mrs|ms|dr|prof|herr|frau|señor|señora|monsieur|madame|dear|patient|contact|sincerely|regards",
          "number": "phone|tel|call|mobile|ssn|social security|passport|licence no|license no|account|born|birth|dob|patient|tax id|nif|dni|steuernummer",
          "address": "address|lives? (?:at|in)|resid(?:es|ing) at|adresse|wohnhaft|dirección|home", "iban": "iban|account|konto|cuenta|compte"}
AGAINST = "version|isbn|issn|page|pages|fig|figure|table|chapter|section|invoice|order|part no|model|serial|copyright|rfc|port|doi|university of|city of|battle of|kingdom of"
BEHIND = {"name": "(?:said|wrote|born|lives|lived|works|signed|called|'s (?:phone|e-?mail|address|passport|account))", "address": r"[0-9]{4,5}|[A-Z]{2} [0-9]{5}", "number": r"\(?(?:home|mobile|office|work)"}
UNITS = r"(?:%|€|\$|£|°|km|kg|mm|cm|mb|gb|eur|usd|pages?|items?|percent|million|billion)(?![\p{L}])"

#: Code points of context kept on each side, and the distance within which a base span is a neighbour.
LEFT, RIGHT, NEAR = 40, 24, 200
#: Lengths from which a new band of the classifier's length feature starts.
BANDS = [8, 16, 32]


def _any(words: list[str]) -> str:
    return "|".join(words)


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, doc_id, hits``: for each input row all matches of all kinds, each with the length of the text between it and the match before.

    ``row`` is a number of the row; write the result before use, since another run may number otherwise.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({f"m{k}": F.regexp_extract_all("text", F.lit(p), F.lit(0)) for k, p in enumerate(PATTERNS.values())})
    rows = rows.withColumns({f"s{k}": F.when(F.size(f"m{k}") > 0, F.split("text", p, -1)) for k, p in enumerate(PATTERNS.values())})
    hit = ("zip_with(m{k}, zip_with(slice(s{k}, 1, size(m{k})), slice(s{k}, 2, size(m{k})), (a, b) -> struct(a, b)), (m, p) -> struct({k} as kind, length(p.a) as gap, length(m) as size, m as part, "
           f"right(p.a, {LEFT}) as left, left(p.b, {RIGHT}) as right))")
    none = "cast(array() as array<struct<kind:int,gap:int,size:int,part:string,left:string,right:string>>)"
    each = [F.expr(f"if(size(m{k}) > 0, {hit.format(k=k)}, {none})") for k in range(len(PATTERNS))]
    return rows.select("row", "doc_id", F.concat(*each).alias("hits"))


def luhn(digits: str) -> Column:
    """Whether a string of digits passes the Luhn check."""
    value = f"cast(substring({digits}, -i, 1) as int)"
    return F.expr(f"aggregate(sequence(1, greatest(length({digits}), 1)), 0, (s, i) -> s + if(i % 2 = 1, {value}, if({value} > 4, 2 * {value} - 9, 2 * {value}))) % 10 = 0")


def iban_valid(part: str) -> Column:
    """Whether a bank account number leaves 1 modulo 97."""
    plain = f"replace({part}, ' ', '')"
    turned = f"concat(substring({plain}, 5), substring({plain}, 1, 4))"
    return F.expr(f"aggregate(split({turned}, ''), 0, (s, c) -> if(c = '', s, if(c between '0' and '9', (s * 10 + ascii(c) - 48) % 97, (s * 100 + ascii(c) - 55) % 97))) = 1")


def candidates(scanned: DataFrame) -> DataFrame:
    """One row per match: ``row, kind, start, end, part, left, right``, positions in code points, end exclusive."""
    rows = scanned.select("row", F.posexplode("hits").alias("at", "h")).select("row", "at", "h.*")
    before = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(before)
    rows = rows.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.col("size")).withColumn("digits", F.regexp_replace("part", "[^0-9]", ""))
    n = F.length("digits")
    good = (F.when(F.col("kind") == 0, True).when(F.col("kind") == 1, F.col("part").rlike(IP_PARTS)).when(F.col("kind") == 2, F.when(n.between(14, 19), luhn("left(digits, 19)")).otherwise(False))
            .when(F.col("kind") == 3, n.between(10, 15)).when(F.col("kind") == 5, n.between(7, 17)).otherwise(True))
    rows = rows.withColumn("good", good).filter(f"good or kind < {BASE}")
    # base spans around each candidate: what ends last before it, what begins first behind it
    rows = rows.withColumn("base", F.col("good") & (F.col("kind") < BASE))
    back = [F.desc("start"), F.col("base"), F.desc("kind")]
    above, below = (Window.partitionBy("row").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1) for keys in (["start", F.desc("base"), "kind"], back))
    last = F.max(F.when(F.col("base"), F.col("end"))).over(above)
    next_ = F.min(F.when(F.col("base"), F.col("start"))).over(below)  # a frame that grows, in reverse: one that shrinks is summed anew for each row
    rows = rows.withColumn("last", last).withColumn("next", next_)
    clash = F.coalesce(F.col("last") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False))
    # a candidate that a base span overlaps has nothing to add; what failed a fixed rule stays as an example of that
    return rows.filter(F.col("base") | ~clash)


def votes(rows: DataFrame) -> DataFrame:
    """Adds a column for each labeler: 1 speaks for personal data, 0 against, null abstains; and the classifier's further features."""
    kind, part = F.col("kind"), F.col("part")
    left, right = F.lower("left"), F.col("right")
    is_ = lambda name: kind == KINDS.index(name)
    words = F.split(part, r"\x20")
    twice = F.size(F.array_distinct(words)) < F.size(words)
    initial = part.rlike(r"\x20\p{Lu}\.\x20")
    person = part.rlike(r"^\(?[2-9][0-9]{2}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^0[0-9]{2,4}[\x20/-][0-9\x20]{5,10}$")
    date = part.rlike(r"^(?:1[0-9]|20)[0-9]{2}[./-][01]?[0-9][./-][0-3]?[0-9]$|^[0-3]?[0-9][./-][01]?[0-9][./-](?:1[0-9]|20)?[0-9]{2}$")
    idle = part.rlike(r"^([0-9])\1*$|[0-9]\.[0-9]+\.[0-9]|^[0-9]+\.[0-9]+$|^(?:1[0-9]|20)[0-9]{2}\x20?-\x20?(?:1[0-9]|20)?[0-9]{2}$")
    form = (F.when(is_("name"), F.when(twice, 0).when(initial, 1)).when(is_("number"), F.when(person, 1).when(idle, 0))
            .when(is_("iban"), iban_valid("part").cast("int")).when(is_("address"), F.lit(None).cast("int")).otherwise(F.col("good").cast("int")))
    born = left.rlike(r"(?:born|birth|dob)[^\n]{0,12}$")
    gazetteer = (F.when(is_("name"), F.when(part.rlike(rf"(?:^|\x20)(?:{_any(NOT_NAMES)})(?:\x20|$)"), 0).when(part.rlike(rf"^(?:{_any(GIVEN)})\x20"), 1))
                 .when(is_("iban"), F.substring(part, 1, 2).isin(IBAN_COUNTRIES).cast("int")).when(is_("number"), F.when(date, F.when(born, 1).otherwise(0)))
                 .when(is_("ip"), F.when(part.rlike(r"^(?:0|10|127|192\.168|255)\."), 0)).when(is_("card"), F.when(F.col("digits").rlike("^(?:4|5[1-5]|3[47]|6011|65)"), 1))
                 .when(is_("email"), F.when(part.rlike(r"\.[A-Za-z]{2,6}$"), 1)))
    cue = reduce(lambda done, k: done.when(kind == k, left.rlike(rf"(?<![\p{{L}}])(?:{BEFORE[KINDS[k]]})(?![\p{{L}}])[^\n]{{0,14}}$")), range(1, len(KINDS)),
                 F.when(kind == 0, left.rlike(rf"(?<![\p{{L}}])(?:{BEFORE['email']})(?![\p{{L}}])[^\n]{{0,14}}$")))
    before = F.when(cue, 1).when(left.rlike(rf"(?<![\p{{L}}])(?:{AGAINST})(?![\p{{L}}])[^\n]{{0,8}}$|[#$€£]\x20?$"), 0)
    follows = F.lit(False)
    for name, words_ in BEHIND.items():
        follows = follows | (is_(name) & right.rlike(rf"^,?\x20?(?:{words_})"))
    behind = F.when(follows, 1).when(F.lower(right).rlike(rf"^\x20?{UNITS}"), 0)
    close = (F.col("start") - F.col("last") <= NEAR) | (F.col("next") - F.col("end") <= NEAR)
    length = F.length(part)
    return rows.withColumns({"format": form, "gazetteer": gazetteer, "before": before, "behind": behind, "near": F.when(close, 1),
                             "band": reduce(lambda a, b: a + b, [(length >= b).cast("int") for b in BANDS]), "opens": F.col("left").rlike(r"(?:^|\n)[\x20\t]*$").cast("int")})


def reliabilities(kind: np.ndarray, ballots: np.ndarray, known: np.ndarray, count: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``prior`` of each kind, each labeler's rate of votes for personal data on such spans (``hit``) and on others (``fault``), and the posterior of each pattern.

    ``ballots`` has 1, 0 or -1 (abstains, which says nothing) for each pattern and labeler; ``known`` is 1 or 0 where the fixed
    rules decide, else -1; ``count`` is how many spans have the pattern. Expectation-maximisation on two classes whose votes
    are independent. Labelers are taken to be better than chance and no kind to be mostly personal data, so votes never turn
    their meaning and silence alone never convicts.
    """
    prior, hit, fault = np.full(len(KINDS), 0.1), np.full(ballots.shape[1], 0.8), np.full(ballots.shape[1], 0.2)
    says, mute = ballots == 1, ballots == -1
    q = np.zeros(len(kind))
    for _ in range(rounds):
        for_ = np.where(mute, 0, np.log(np.where(says, hit, 1 - hit))).sum(1)
        against = np.where(mute, 0, np.log(np.where(says, fault, 1 - fault))).sum(1)
        odds = np.log(prior[kind]) - np.log1p(-prior[kind]) + for_ - against
        new = np.where(known >= 0, known, 1 / (1 + np.exp(-np.clip(odds, -60, 60))))
        yes, no = count * new, count * (1 - new)
        voted = ~mute
        # ten spans' worth of the first guess keeps a labeler that hardly votes where it is
        hit = np.clip(((yes[:, None] * says).sum(0) + 8) / ((yes[:, None] * voted).sum(0) + 10), 0.55, 0.99)
        fault = np.clip(((no[:, None] * says).sum(0) + 2) / ((no[:, None] * voted).sum(0) + 10), 0.01, 0.45)
        open_ = known < 0
        total = np.bincount(kind[open_], count[open_], len(KINDS))
        prior = np.clip((np.bincount(kind[open_], yes[open_], len(KINDS)) + 1) / (total + 10), 0.005, 0.3)
        if np.abs(new - q).max(initial=0) < 1e-9:
            break
        q = new
    return prior, hit, fault, new


def features(kind: np.ndarray, ballots: np.ndarray, band: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """One column each: constant; kinds after the first; votes for, votes against by labeler; length bands; opens a line."""
    return np.column_stack([np.ones(len(kind)), *[kind == k for k in range(1, len(KINDS))], ballots == 1, ballots == 0, *[band >= b + 1 for b in range(len(BANDS))], opens]).astype(float)


def weights(x: np.ndarray, target: np.ndarray, count: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression on soft targets by Newton steps; the constant is free."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (count * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (count * (target - p)) - penalty * w)
        size = np.abs(step).max()
        w += step * min(1.0, 5 / max(size, 1e-12))
        if size < 1e-10:
            break
    return w


def fit(rows: DataFrame) -> tuple[np.ndarray, dict]:
    """Weights of the span classifier, and what expectation-maximisation found.

    The counts of vote patterns come to the driver: at most kinds x 3^5 votes x 3 states x 4 bands x 2, however many spans.
    """
    known = F.when(F.col("kind") < BASE, F.col("base").cast("int")).otherwise(-1)
    cells = [F.coalesce(F.col(v), F.lit(-1)).alias(v) for v in LABELERS]
    counts = rows.select("kind", *cells, known.alias("known"), "band", "opens").groupBy("kind", *LABELERS, "known", "band", "opens").agg(F.count("*").alias("n"))
    grid = np.array([list(r) for r in sorted(counts.collect())], dtype=np.int64).reshape(-1, len(LABELERS) + 5)
    kind, ballots, (given, band, opens, n) = grid[:, 0], grid[:, 1:1 + len(LABELERS)], grid[:, 1 + len(LABELERS):].T
    prior, hit, fault, q = reliabilities(kind, ballots, given, n.astype(float))
    w = weights(features(kind, ballots, band, opens), q, n.astype(float)) if len(grid) else np.zeros(features(kind, ballots, band, opens).shape[1])
    return w, {"prior": prior, "hit": hit, "fault": fault}


def score(w: np.ndarray) -> Column:
    """Probability of a span by the fitted classifier, as a column."""
    kind = [F.col("kind") == k for k in range(1, len(KINDS))]
    on = [F.lit(True), *kind, *[F.coalesce(F.col(v) == 1, F.lit(False)) for v in LABELERS], *[F.coalesce(F.col(v) == 0, F.lit(False)) for v in LABELERS], *[F.col("band") >= b + 1 for b in range(len(BANDS))], F.col("opens") == 1]
    total = reduce(lambda a, b: a + b, [F.when(c, F.lit(float(v))).otherwise(F.lit(0.0)) for c, v in zip(on, w, strict=True)])
    return 1 / (1 + F.exp(-total))


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``row, doc_id, base, spans`` per input row: arrays of ``start, kind, end`` in code points, ordered by start, then kind.

    ``base`` has what the fixed rules find: e-mail and IP addresses, card and phone numbers. ``spans`` adds names, other personal
    numbers, postal addresses and bank accounts that no base span overlaps and to which the classifier gives a probability
    above ``threshold``; at least one labeler must speak for them.

    A null or empty text has no spans. Null and repeated ids are separate rows, repeated rows count as often as they occur. An
    empty table gives an empty result. Other columns play no part. All counts and fits cover all rows.
    """
    scanned = staged(scan(docs, id_col, text_col), "personal")
    rows = staged(votes(candidates(scanned)).select("row", "kind", "start", "end", "base", *LABELERS, "band", "opens"), "votes")
    w, _ = fit(rows)
    for_ = reduce(lambda a, b: a | b, [F.coalesce(F.col(v) == 1, F.lit(False)) for v in LABELERS])
    kept = rows.filter(F.col("base") | ((F.col("kind") >= BASE) & for_ & (score(w) > threshold)))
    span = F.struct("start", "kind", "end")
    each = kept.groupBy("row").agg(F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.sort_array(F.collect_list(span)).alias("spans"))
    out = scanned.select("row", "doc_id").join(each, "row", "left")
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    return out.select("row", "doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def listed(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = f"array({', '.join(repr(k) for k in KINDS)})"
    return F.expr(f"array_join(transform({spans}, x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ',')")


@query("op13_weak_supervision_pii")
def op13_weak_supervision_pii(spark: SparkSession, d: str) -> DataFrame:
    spans = find_personal(table(spark, d, "documents"))
    n = [F.expr(f"cast(size(filter(base, x -> x.kind = {k})) as bigint)").alias(f"n_{KINDS[k]}") for k in range(BASE)]
    return spans.select("doc_id", *n, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
