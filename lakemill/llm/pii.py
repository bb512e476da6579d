"""Personal data by candidate gradient boosting.

Base spans (email, ip, card, phone) come from fixed patterns and checks.
High-recall generators propose further, overlapping spans: obfuscated mail
addresses, digit groups of any shape, account numbers. Boosted trees score each
proposal from its format and from the words around it, thresholds are
calibrated for precision on held-out examples, and proposals that pass are
added, unless they lie within a base span or another proposal that passes.

There are no labelled spans in the corpus, so the trees are fitted on made
examples (`examples`, a fixed number of them); the same DataFrame expressions
make their features and the corpus's. Scoring is the trees as an expression.
"""

from __future__ import annotations

import random
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakemill.llm import boost
from lakemill.llm.common import stage
from lakemill.llm.spans import digits, joined, luhn, spans, tagged

#: The base patterns. Possessive quantifiers and look-behinds
#: take the run that the plain pattern takes, without its backtracking; \G is
#: where the match before ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The generators.
_AT, _DOT = r"(?:@|[\[({<]at[\])}>])", r"(?:\.|[\[({<]dot[\])}>])"
#: A bare "at" only counts with a bare "dot": with a full stop it is a sentence's end.
MAILISH = rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+(?:\x20?{_AT}\x20?[A-Za-z0-9-]++(?:\x20?{_DOT}\x20?[A-Za-z0-9-]{{2,}}+)++|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]{{2,}}+)++)"
#: A colon before a number only counts behind a letter: "Tel:555", not a time.
NUMBERISH = r"(?<![0-9A-Za-z.,/+-])(?<![^A-Za-z]:)(?<!^:)[(]?[0-9](?:[\x20().-]{0,2}+[0-9]){6,}+(?![0-9A-Za-z/:]|[.,-][0-9])"
IBANISH = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"  # gives back the first capital of a next word
GENERATORS = (("mailish", MAILISH), ("numberish", NUMBERISH), ("ibanish", IBANISH))
#: Context words, as patterns over the lower-cased neighbourhood.
CONTEXT = {
    "phone": r"phone|tel\b|tel\.|telefon|téléphone|teléfono|mobile|cell|handy|call|fax|whatsapp",
    "person": r"ssn|social security|passport|sozialversicherung|national id|dni\b|tax id|born|patient",
    "money": r"iban|account|konto|compte|cuenta|card|karte|carte|tarjeta|bank|visa\b|credit",
    "mail": r"mail|contact|write|correo|courriel|reach",
    "other": r"order|invoice|isbn|issn|version|ref\b|ref\.|ticket|serial|part no|page|total|euro|usd|price|model|sku|build|commit|section|article|doi",
}
AROUND = 32
#: Rank of the first generator; base kinds have lower ones.
OWN = 10
PRECISION = 0.995
EXAMPLES = 4000


def base(text: Column) -> Column:
    part_ok = lambda p: F.forall(F.split(p, r"\."), lambda x: (F.char_length(F.regexp_replace(x, "^0+", "")) <= 3) & (F.substring(x, -3, 3).cast("int") <= 255))
    in_range = lambda p, lo, hi: F.char_length(digits(p)).between(lo, hi)
    return F.concat(
        tagged(spans(text, EMAIL, "@"), 0, "email"),
        tagged(spans(text, IP, ".", part_ok), 1, "ip"),
        tagged(spans(text, CARD, None, lambda p: F.when(in_range(p, 14, 19), luhn(p)).otherwise(False)), 2, "card"),
        tagged(spans(text, PHONE, "+", lambda p: in_range(p, 10, 15)), 3, "phone"),
    )


def proposals(text: Column) -> Column:
    may = {"mailish": text.rlike(r"(?i)@|[\[({<]at[\])}>]|\x20dot\x20"), "numberish": text.rlike("[0-9]"), "ibanish": text.rlike(r"[A-Z]{2}[0-9]{2}")}
    near = ("before", "after")
    none = lambda: F.slice(tagged(spans(F.lit(""), "x", around=AROUND), 0, "", *near), 1, 0)
    return F.concat(*[F.when(may[k], tagged(spans(text, pattern, around=AROUND), OWN + r, k, *near)).otherwise(none()) for r, (k, pattern) in enumerate(GENERATORS)])


FEATURES = ("rank", "length", "n_digits", "n_groups", "longest", "n_letters", "n_separators", "parens", "hyphens", "luhn", "at_sign", "dots", "known_domain", "same_digit", "spelled_at", "spelled_dot", "bracketed", "dot_space", "upper_end", *(f"before_{k}" for k in CONTEXT), *(f"after_{k}" for k in CONTEXT))


def features(s: Column) -> list[Column]:
    """Numbers for one proposal, in the order of FEATURES."""
    m = s["match"]
    count = lambda chars: F.char_length(m) - F.char_length(F.regexp_replace(m, chars, ""))
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: F.char_length(g) > 0)
    before, after = F.lower(s["before"]), F.lower(s["after"])
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    own = [
        s["rank"], F.char_length(m), F.char_length(digits(m)), F.size(groups), F.coalesce(F.array_max(F.transform(groups, F.char_length)), F.lit(0)), count("[A-Za-z]"),
        count(r"[\x20().-]"), count("[()]"), count("-"), F.when(F.char_length(digits(m)).between(12, 19), luhn(m)).otherwise(False), F.contains(m, F.lit("@")), count(r"\."),
        F.lower(m).rlike(r"[.\x20\])}>](com|org|net|de|fr|es|edu|io|uk)$"), F.size(F.array_distinct(F.split(digits(m), ""))),
        F.lower(m).rlike(r"\x20at\x20"), F.lower(m).rlike(r"\x20dot\x20"), m.rlike(r"[\[({<]"), m.rlike(r"\.\x20"), m.rlike(r"[.\x20][A-Z][a-z]*$"),
    ]
    near = lambda side: [side.rlike(rf"\b(?:{w})") for w in CONTEXT.values()]  # noqa: E731  at the start of a word
    return [number(c) for c in (*own, *near(before), *near(after))]


def examples(n: int = EXAMPLES, seed: int = 7) -> list[tuple[str, int]]:
    """Made sentences, one proposal each in most cases: 1 if it is personal."""
    rnd = random.Random(seed)
    d = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    name = lambda: rnd.choice(["anna", "j.doe", "li_wei", "m-lopez", "sam99", "info", "kurt"])
    dom = lambda: rnd.choice(["mail", "example", "uni-x", "corp"])
    end = lambda: rnd.choice(["com", "org", "de", "fr", "es", "net"])
    part = lambda: "".join(rnd.choice("th er in on re an ti at he ea la que ou de eau sch ung ie ción as ado os".split()) for _ in range(rnd.randint(1, 3)))
    filler = lambda: " ".join(rnd.choice("the of and over il la der to that wo from which ingen there onward".split()) for _ in range(rnd.randint(0, 6)))
    good = (
        ("tel", lambda: f"{rnd.choice(['tel.', 'phone', 'call', 'mobile', 'fax', 'Telefon'])} ({d(3)}) {d(3)}-{d(4)}"),
        ("tel", lambda: f"{rnd.choice(['phone:', 'call me on', 'whatsapp', 'cell'])} 0{d(3)} {d(3)} {d(4)}"),
        ("tel", lambda: f"({d(3)}) {d(3)}-{d(4)}"),
        ("tel", lambda: f"{rnd.choice(['phone', 'tel.'])} {d(3)}-{d(3)}-{d(4)}"),
        ("ssn", lambda: f"{rnd.choice(['ssn', 'social security number', 'tax id', 'patient'])} {d(3)}-{d(2)}-{d(4)}"),
        ("iban", lambda: f"{rnd.choice(['iban', 'account', 'konto', 'compte'])} {rnd.choice(['DE', 'FR', 'ES'])}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)}"),
        ("iban", lambda: f"{rnd.choice(['IBAN', 'Konto', 'account'])} DE{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)} {part().capitalize()}"),
        ("iban", lambda: f"{rnd.choice(['IBAN', 'Konto', 'account'])} {rnd.choice(['DE', 'FR', 'ES'])}{d(20)} {part().capitalize()}"),
        ("ssn", lambda: f"{rnd.choice(['SSN', 'ssn', 'tax id'])}:{d(3)}-{d(2)}-{d(4)}"),
        ("tel", lambda: f"{rnd.choice(['Tel', 'phone', 'Fax'])}:{d(3)}-{d(3)}-{d(4)}"),
        ("mail", lambda: f"{rnd.choice(['mail', 'contact', 'write to', ''])} {name()} {rnd.choice(['[at]', '(at)'])} {dom()} {rnd.choice(['[dot]', '(dot)', '.'])} {end()}"),
        ("mail", lambda: f"{rnd.choice(['mail', 'reach me:'])} {name()} at {dom()} dot {end()}"),
    )
    bad = (
        lambda: f"{rnd.choice(['order', 'invoice', 'ticket', 'ref.', 'serial'])} {d(rnd.randint(7, 12))}",
        lambda: f"isbn 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
        lambda: f"{rnd.choice(['in', 'on', 'since'])} {rnd.randint(1900, 2030)}-{rnd.randint(10, 12)}-{rnd.randint(10, 28)} {d(2)}.{d(2)}",
        lambda: f"{d(rnd.randint(7, 24))}",
        lambda: f"total {d(2)} {d(3)} {d(3)} {rnd.choice(['euro', 'usd'])}",
        lambda: f"{d(1)} {d(2)} {d(3)} {d(2)} {d(1)} {d(3)}",
        lambda: f"version {d(1)}.{d(2)}.{d(4)}",
        lambda: f"page {d(3)} {d(4)}",
        lambda: f"{rnd.choice(['order', 'ref', 'invoice'])}:{d(rnd.randint(7, 12))}",
        lambda: f"{rnd.choice(['serial', 'model', 'sku'])} {rnd.choice(['AB', 'XK', 'QT'])}{d(2)} {d(4)} {d(4)} {d(4)} {part().capitalize()}",
        lambda: f"{d(3)}-{d(2)}-{d(4)}-{d(5)}",
        lambda: f"{part()} (at) {part()}. {rnd.choice([part(), end()]).capitalize()} {part()}",
        lambda: f"{part()} at {rnd.choice(['it', 'a', part()])} dot {part()}",
        lambda: f"{rnd.choice(['serial', 'model', 'sku'])} {rnd.choice(['AB', 'XK', 'QT'])}{d(2)} {d(4)} {d(4)} {d(4)}",
        lambda: f"{rnd.choice(['red', 'blue', part()])} at {rnd.choice(['noon', 'sea', part()])} dot {rnd.choice(['matrix', 'product', part()])}",
        lambda: f"commit {rnd.choice(['AB', 'FF'])}{d(6)}AB{d(6)}CD{d(4)}",
    )
    out = []
    for k in range(n):
        text, y = (rnd.choice(good)[1](), 1) if k % 2 else (rnd.choice(bad)(), 0)
        out.append((f"{filler()} {text} {filler()}".strip(), y))
    return out


@lru_cache(maxsize=1)
def _fitted(rows: tuple) -> tuple[boost.Boosted, float]:
    import numpy as np

    x, y = np.array([r[0] for r in rows], dtype=float), np.array([r[1] for r in rows])
    held = np.arange(len(y)) % 4 == 0
    model = boost.fit(x[~held], y[~held])
    # Where held-out examples leave a gap, a proposal must still be likelier than not.
    return model, max(0.5, boost.threshold(boost.sigmoid(model.logit(x[held])), y[held], PRECISION))


def model(spark: SparkSession) -> tuple[boost.Boosted, float]:
    """The fitted trees and the calibrated threshold; the driver gets the
    features of at most EXAMPLES made sentences."""
    made = spark.createDataFrame(examples(), "text string, y int").withColumn("s", F.explode(proposals(F.col("text"))))
    rows = made.select(F.array(*features(F.col("s"))).alias("x"), "y").collect()
    return _fitted(tuple((tuple(r.x), r.y) for r in rows))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row doc_id, base and spans: arrays of struct<start, rank, end,
    kind, match, score>, sorted by start and kind; base spans have score 1.

    Null text is empty. Overlapping base kinds are all reported, so are added
    spans that overlap without one holding the other; of equal spans the base
    one stays, then the earlier generator's. Texts of any length are scanned
    whole; time grows with their length and spans. Repeated rows are reported
    alike, each by itself, also under a null id. Empty table: no rows. Other
    columns are not looked at.
    """
    trees, least = model(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumns({"base": F.sort_array(base(F.col("text"))), "more": proposals(F.col("text"))})
    own_fields = ("start", "rank", "end", "kind", "match")
    named = lambda s, score: F.struct(*[s[c].alias(c) for c in own_fields], score.alias("score"))

    def score(s: Column) -> Column:
        return trees.expression(lambda i: s["x"][i], F.when, F.lit)

    x = F.transform("more", lambda s: F.struct(*[s[c].alias(c) for c in own_fields], F.array(*features(s)).alias("x")))
    rows = rows.withColumn("more", F.when(F.size("more") > 0, x).otherwise(F.slice(x, 1, 0)))
    # The texts are read once and stay behind; from here on a document is its row.
    rows = stage(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", "more"), "candidates")
    scored = F.transform("more", lambda s: named(s, 1 / (1 + F.exp(-score(s)))))
    own = F.transform("base", lambda s: named(s, F.lit(1.0)))
    passing = F.when(F.size("more") > 0, F.filter(scored, lambda s: s["score"] >= least)).otherwise(F.slice(scored, 1, 0))
    some = rows.where(F.size("more") > 0).select("row", own.alias("own"), passing.alias("passing")).where(F.size("passing") > 0)
    each = some.select("row", F.explode(F.concat("own", "passing")).alias("s")).select("row", "s.*")
    before = Window.partitionBy("row").orderBy("start", F.desc("end"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("reach", F.max("end").over(before)).where((F.col("rank") < OWN) | F.col("reach").isNull() | (F.col("reach") < F.col("end")))
    more = each.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(*own_fields, "score"))).alias("spans"))
    return rows.join(more, "row", "left").select("doc_id", own.alias("base"), F.coalesce("spans", own).alias("spans"))


def redact(text: str, found: list) -> str:
    """The text with each span replaced by its kind in brackets; overlapping
    spans are replaced as one."""
    out, at = [], 0
    for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind']}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def digest(spans_col: str) -> Column:
    return F.sha2(joined(F.col(spans_col)), 256)
