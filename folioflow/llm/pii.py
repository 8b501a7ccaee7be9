"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust their score.

DataFrame functions throughout. The matches of an expression are set between two marks by one pass of
`regexp_replace`; splitting at the marks gives the pieces, and running sums of their lengths the places.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import documents, own_name

#: Two noncharacters set around matches; where a text has them they count as a third.
OPEN, CLOSE, OTHER = "﷐", "﷑", "﷒"
#: Characters before and after a match in which context words count.
NEAR = 40
#: A span is reported from this score on.
LEAST_SCORE = 0.6
#: A text is cut to blocks of so many characters, in which a match's neighbourhood is found without counting from the text's head.
CUT = 256
#: Running sums go by runs of this many.
RUN = 128


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A cheap expression that every text with a match satisfies: a substring, or a regular expression if `gate_re`.
    gate: str
    gate_re: bool = False
    #: Score of a match that its validator confirms, and what a context word nearby adds.
    score: float = 0.9
    context: str = ""
    bonus: float = 0.0


# The four base expressions, in forms that Java runs in linear time. A match that starts inside a run
# of its first class starts at the run's head or where the last match ended.
BASE_KINDS = [
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}", True, 0.9, r"card|visa|karte|carte|tarjeta|credit", 0.1),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", False, 0.9, r"tel|phone|call|mobil|fax", 0.1),
]
MORE_KINDS = [
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}[A-Z0-9\x20]{10}", True, 0.9, r"iban|konto|account|compte|cuenta", 0.1),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", True, 0.4, r"\bssn\b|social security", 0.5),
    Kind("local_phone", r"(?<![0-9+])(?<![0-9+][\x20.)-])(?<![0-9+][\x20.-]?\()(?:\([0-9]{3}\)|[0-9]{3}\)?)[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", True, 0.3, r"\btel|phone|call|mobil", 0.4),
]
KINDS = BASE_KINDS + MORE_KINDS


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.ascii(digits.substr(n - i + 1, F.lit(1))) - 48
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), step) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks leaves 1 modulo 97, its head put last and letters read as 10 to 35."""
    turned = F.concat(iban.substr(F.lit(5), F.length(iban)), iban.substr(1, 4))

    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(turned.substr(i, F.lit(1)))
        return F.when(c <= 57, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def valid(kind: str, match: Column) -> Column:
    """The checks that a match must pass."""
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(match, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.lpad(part(p), 3, "0") <= "255"))
    if kind == "card":
        d = _digits(match)
        return F.length(d).between(13, 19) & luhn(d)
    if kind in ("phone", "local_phone"):
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return mod97(F.replace(match, F.lit(" "), F.lit("")))
    if kind == "ssn":
        return ~match.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def _sums(values: Column) -> Column:
    """Sums of the values before each."""
    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, start, lambda s, x: F.struct((s["total"] + x).alias("total"), F.concat(s["out"], F.array(s["total"])).alias("out")), lambda s: s["out"])


def running_sums(values: Column) -> Column:
    """Sums of the values before each, of a long array too: runs, sums of runs, then within runs."""
    runs = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / RUN).cast("int")), lambda r: F.slice(values, r * RUN + 1, F.lit(RUN)))
    totals = _sums(F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda s, x: s + x)))
    return F.flatten(F.zip_with(runs, totals, lambda run, before: F.transform(_sums(run), lambda x: x + before)))


def with_spans(docs: DataFrame, kinds: list[Kind] = KINDS, text: str = "text", prefix: str = "__pii_") -> DataFrame:
    """`docs` with one column for each kind, prefix + name: its spans (start, end in code points, match, score), ascending.

    Null or empty text has none. Expressions run only on texts that pass their kind's gate.
    """
    out = docs
    for k in kinds:
        c = F.col(text)
        gate = c.rlike(k.gate) if k.gate_re else c.contains(k.gate)
        plain = F.translate(c, OPEN + CLOSE, OTHER + OTHER)
        out = out.withColumn(f"{prefix}{k.name}", F.when(gate, F.split(F.regexp_replace(plain, f"(?:{k.pattern})", f"{OPEN}$0{CLOSE}"), OPEN)))
    for k in kinds:
        p = F.col(f"{prefix}{k.name}")
        # pieces: what stands before the first match, then each match, a mark and what follows it
        out = out.withColumn(f"{prefix}{k.name}", F.when(F.size(p) > 1, F.struct(F.length(p[0]).alias("head"), F.slice(p, F.lit(2), F.size(p)).alias("pieces"))))
    for k in kinds:
        p = F.col(f"{prefix}{k.name}")
        out = out.withColumn(f"{prefix}{k.name}", F.when(p.isNotNull(), F.zip_with(p["pieces"], running_sums(F.transform(p["pieces"], lambda x: F.length(x) - 1)), _placed(p["head"]))))
    blocks, some = own_name(out, "blocks"), [F.col(f"{prefix}{k.name}").isNotNull() for k in kinds if k.context]
    if some:
        out = out.withColumn(blocks, F.when(reduce(Column.__or__, some), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))))
    for k in kinds:
        p = F.col(f"{prefix}{k.name}")
        out = out.withColumn(f"{prefix}{k.name}", F.when(p.isNotNull(), F.filter(F.transform(F.filter(p, _confirmed(k)), _scored(k, blocks)), lambda m: m["score"] >= LEAST_SCORE)))
    return out.drop(blocks)


def _placed(head: Column):
    def place(piece: Column, before: Column) -> Column:
        match = F.substring_index(piece, CLOSE, 1)
        return F.struct((head + before).alias("start"), (head + before + F.length(match)).alias("end"), match.alias("match"))

    return place


def _confirmed(kind: Kind):
    return lambda m: valid(kind.name, m["match"])


def _named(kind: Kind):
    return lambda m: F.struct(F.lit(kind.name).alias("kind"), m["start"].cast("long").alias("start"), m["end"].cast("long").alias("end"), m["match"].alias("match"), m["score"].alias("score"))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def _stretch(blocks: Column, at: Column, n: Column) -> Column:
    """`n` characters, CUT at most, of the text from `at` on."""
    b = F.floor(at / CUT).cast("int")
    return F.substring(F.concat(F.coalesce(F.get(blocks, b), F.lit("")), F.coalesce(F.get(blocks, b + 1), F.lit(""))), at % CUT + 1, n)


def _scored(kind: Kind, blocks: str):
    def score(m: Column) -> Column:
        s = F.lit(kind.score)
        if kind.context:
            at = F.greatest(m["start"] - NEAR, F.lit(0))
            near = F.concat_ws("\n", _stretch(F.col(blocks), at, m["start"] - at), _stretch(F.col(blocks), m["end"], F.lit(NEAR)))
            s = s + F.when(F.lower(near).rlike(kind.context), kind.bonus).otherwise(0.0)
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["match"].alias("match"), s.alias("score"))

    return score


def find_personal_data(docs: DataFrame, kinds: list[Kind] = KINDS, name: str = "pii") -> DataFrame:
    """`docs` with an array of (kind, start, end, match, score), by kind as listed, then start. A column of that name is replaced.

    Null or empty text has none; texts of any length are searched whole; rows repeated are searched alike; spans that
    start together stand in the order of their kinds. Other columns pass through. An empty table gives an empty one.
    """
    found = with_spans(docs.select(F.struct("*").alias("row"), F.col("text").alias("text")), kinds)
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,match:string,score:double>>")
    said = [F.coalesce(F.transform(F.col(f"__pii_{k.name}"), _named(k)), none) for k in kinds]
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() != name.lower()], F.concat(*said).alias(name))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "pii")
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = [k.name for k in BASE_KINDS]
    counts = [F.size(F.filter("pii", _is(k))).cast("long").alias(f"n_{k}") for k in base]
    in_base = F.filter("pii", lambda s: s["kind"].isin(base))
    return found.select("doc_id", *counts, F.sha2(F.array_join(F.transform(in_base, line), ","), 256).alias("base_sha256"), F.array_join(F.transform("pii", line), ",").alias("spans"))
