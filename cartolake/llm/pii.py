"""Personal data: candidate spans, scored by boosted trees, with calibrated thresholds.

Base rules find spans of four kinds by format; they always stay. Several high-recall generators
a kind propose further, overlapping candidates (numbers of any grouping, addresses that are spelled
out, long addresses of hosts, keys), gradient-boosted trees score them by format and context, and a
threshold for each kind, calibrated on rows of other templates than those trained on, selects; of
candidates that overlap the likelier stays. All work on texts is DataFrame expressions; the trees
are those of Spark ML and are trained here on generated rows.

Patterns run on a text whose separators inside numbers and names are replaced one for one, so
that every repetition is one of single characters: no pattern backtracks over a long text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce
from operator import or_

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolake.llm.common import saved, table

KINDS = ("email", "ip", "card", "phone")
#: Stand for a separator between two digits, and for a dot between two characters of a name.
SEP, DOT = "\x01", "\x02"
LABEL = "A-Za-z0-9-"
LOCAL = f"A-Za-z0-9._%+{DOT}-"
BASE = {
    "email": f"(?:(?<![{LOCAL}])|\\G)[{LOCAL}]++@[{LABEL}]++{DOT}[{LABEL}{DOT}]++",
    "ip": f"(?<![0-9])[0-9]++{DOT}[0-9]++{DOT}[0-9]++{DOT}[0-9]++",
    "card": f"[0-9][0-9{SEP}]++",
    "phone": f"\\+[0-9][ ().0-9{SEP}{DOT}-]+[0-9]",
}
#: Beside the base kinds the method finds keys and tokens.
ALL_KINDS = (*KINDS, "secret")
_AT, _DOT = r"(?:at|AT|@)", r"(?:dot|DOT|\.)"
_NAME, _HOST = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+", r"[A-Za-z0-9-]{1,63}+"
_OPEN, _CLOSE = r" ?[\[({<]", r"[\])}>] ?"
#: Generators beyond the base: kind, a quick test of the text, and the pattern. They overlap on purpose.
PROPOSED = (
    ("email", r"[\[({<](?:at|AT|@)[\])}>]", f"{_NAME}{_OPEN}{_AT}{_CLOSE}{_HOST}(?:{_OPEN}{_DOT}{_CLOSE}{_HOST}| (?:dot|DOT) {_HOST}|\\.{_HOST}){{1,4}}"),
    ("email", r" (?:at|AT) [A-Za-z0-9-]{1,63} (?:dot|DOT) ", f"{_NAME} (?:at|AT) {_HOST}(?: (?:dot|DOT) {_HOST}){{1,4}}"),
    ("email", r"@", f"{_NAME} ?@ ?{_HOST}(?: ?\\. ?[A-Za-z0-9-]{{2,63}}+| (?:dot|DOT) {_HOST}){{1,4}}"),
    ("ip", r"[0-9A-Fa-f]:[0-9A-Fa-f:]", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    ("ip", r"::", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])"),
    ("ip", r"[0-9] ?[\[(](?:\.|dot)", r"(?<![0-9.])[0-9]{1,3}(?: ?[\[(](?:\.|dot)[\])] ?[0-9]{1,3}){3}(?![0-9])"),
    ("ip", r"[0-9] \.", r"(?<![0-9.])[0-9]{1,3}(?: \. ?[0-9]{1,3}){3}(?![0-9])"),
    ("card", r"[0-9]{4}[ ./_-]{1,2}[0-9]{4}", r"(?<![0-9A-Za-z])[0-9]{4}(?:[ ./_-]{1,2}[0-9]{4}){3}(?![0-9A-Za-z])"),
    ("card", r"[0-9]{4}[ ./_-]{1,2}[0-9]{6}", r"(?<![0-9A-Za-z])[0-9]{4}[ ./_-]{1,2}[0-9]{6}[ ./_-]{1,2}[0-9]{5}(?![0-9A-Za-z])"),
    ("card", r"[0-9](?:[ ./_-]?[0-9]){12}", r"(?<![0-9A-Za-z.,])[0-9](?:[ ./_-]?[0-9]){12,18}(?![0-9A-Za-z])"),
    ("phone", r"[0-9]{3}[ .-][0-9]{4}", r"(?<![0-9A-Za-z+.,-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[.,-][0-9])"),
    ("phone", r"0[0-9 )./-]{6}", r"(?<![0-9A-Za-z+.,])(?:00 ?[1-9][0-9]{0,2}|\(?0[0-9]{1,4}\)?)(?:[ ./-]{1,2}[0-9]{2,7}){1,5}(?![0-9A-Za-z])"),
    ("phone", r"[0-9]{2}[ .-][0-9]{2}", r"(?<![0-9A-Za-z+.,])[0-9]{2,4}(?:[ .-][0-9]{2,4}){2,4}(?![0-9A-Za-z])"),
    ("secret", r"[A-Za-z0-9_/+-]{20}", r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*[0-9])[A-Za-z0-9_/+-]{20,200}+={0,2}"),
)
#: Words that often stand before each kind, in a few languages; one feature among others.
CUES = {
    "email": "mail|contact|reach|write|correo|courriel",
    "ip": "ip|host|server|address|addr|client|peer",
    "phone": "phone|call|tel|fax|mobile|cell|whatsapp|handy",
    "card": "card|visa|master|payment|credit|debit|karte|carte|tarjeta",
    "secret": "token|key|secret|passw|bearer|auth|credential",
}
#: Common last labels of host names; one feature among others.
SUFFIXES = "com|org|net|edu|gov|info|io|co|de|fr|es|it|uk|us|eu|nl|ch|at|be|pl|br|mx|in|jp|cn|ru|au|ca"
CONTEXT = 32
SEPARATORS = " ./_-"
FEATURES = (*[f"f_{k}" for k in ALL_KINDS], "f_length", "f_digits", "f_letters", "f_upper", "f_hex", "f_seps", "f_kinds_of_seps", "f_groups", "f_longest", "f_shortest", "f_luhn", "f_zero", "f_paren", "f_brackets", "f_colons", "f_dots", "f_last_word", "f_suffix", "f_cue", "f_other", "f_assigned", "f_quoted", "f_money", "f_unit", "f_digits_before", "f_digits_after", "f_glued")
#: Generated rows that the trees are fitted on, and those held out for the thresholds: fixed, whatever the corpus.
TRAIN_ROWS, HELD_OUT_ROWS = 6000, 4000
PRECISION = 0.98


def _cleaned(text: Column) -> Column:
    """The text with SEP for a space or hyphen between digits, and DOT for a dot between name characters; lengths stay."""
    plain = F.translate(text, SEP + DOT, "??")
    return F.when(text.rlike("[0-9@]"), F.regexp_replace(plain, f"(?<=[{LABEL}])\\.(?=[{LABEL}])", DOT)).otherwise(plain)


NO_SPANS = "array<struct<start:int,end:int,match:string>>"


def _spans(text: Column, pattern: str, valid: Callable[[Column], Column]) -> Column:
    """Matches that are valid, in order: array of (start, end, match), in code points, end exclusive.

    The pieces between matches and the matches give the places; one pass adds up their lengths
    and keeps only what is valid, so a text of many numbers doesn't grow the array.
    """
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(pieces, 1, F.size(matches)).alias("piece"), matches.alias("match"))
    empty = F.array().cast(NO_SPANS)
    zero = F.struct(F.lit(0).alias("upto"), empty.alias("spans"))

    def step(done: Column, pair: Column) -> Column:
        start = done["upto"] + F.length(pair["piece"])
        end = start + F.length(pair["match"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("match"))
        return F.struct(end.alias("upto"), F.when(valid(pair["match"]), F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"))

    return F.when(text.rlike(pattern), F.aggregate(pairs, zero, step, lambda done: done["spans"])).otherwise(empty)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(c == "", 0).otherwise(F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        parts = F.split(match, DOT)
        return F.forall(parts, lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.substring(F.concat(F.lit("0"), F.regexp_replace(p, "^0+", "")), -3, 3).cast("int") <= 255))
    n = F.length(_digits(match))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _needs(kind: str, text: Column) -> Column:
    return F.contains(text, F.lit("@")) if kind == "email" else F.contains(text, F.lit("+")) if kind == "phone" else text.rlike("[0-9]")


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds b_<kind>: arrays of (start, end) of the base rules, in order."""
    cleaned = docs.withColumn("_dots", _cleaned(F.coalesce(F.col(text), F.lit(""))))
    cleaned = cleaned.withColumn("_seps", F.when(F.col("_dots").rlike("[0-9][ -][0-9]"), F.regexp_replace("_dots", "(?<=[0-9])[ -](?=[0-9])", SEP)).otherwise(F.col("_dots")))
    for kind in KINDS:
        source = F.col("_seps" if kind == "card" else "_dots")
        found = F.when(_needs(kind, source), _spans(source, BASE[kind], partial(_valid, kind))).otherwise(F.array().cast(NO_SPANS))
        cleaned = cleaned.withColumn(f"b_{kind}", F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return cleaned.drop("_dots", "_seps")


def candidates(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Proposed spans: the columns of keep, kind, start, end, match, before and after (context). A span that several generators of a kind propose comes once."""
    t = F.col("_t")
    none = F.array().cast(NO_SPANS)
    out = []
    for kind, likely, pattern in PROPOSED:
        found = F.when(t.rlike(likely), _spans(t, pattern, lambda m: F.lit(True))).otherwise(none)
        out.append(F.transform(found, partial(lambda k, s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match")), kind)))
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t")).filter(t.rlike("[0-9@]|[\\[({<](?:at|AT)[\\])}>]| (?:dot|DOT) "))
    rows = rows.select(*keep, "_t", F.array_distinct(F.concat(*out)).alias("_c")).filter(F.size("_c") > 0).select(*keep, "_t", F.explode("_c").alias("c"))
    first = F.greatest(F.col("c.start") - CONTEXT, F.lit(0))
    before = F.substring(t, first + 1, F.col("c.start") - first)
    return rows.select(*keep, "c.*", before.alias("before"), F.substring(t, F.col("c.end") + 1, F.lit(CONTEXT)).alias("after"))


def _features(rows: DataFrame) -> DataFrame:
    """Format and context of each candidate as numbers."""
    m, before, after = F.col("match"), F.lower("before"), F.col("after")
    is_kind = lambda k: F.col("kind") == k
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern))
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")
    sizes = F.transform(groups, lambda g: F.length(g))
    cue = reduce(lambda a, k: F.when(is_kind(k), before.rlike(CUES[k])).otherwise(a), CUES, F.lit(False))
    digits = _digits(m)
    values = {
        **{f"f_{k}": is_kind(k) for k in ALL_KINDS},
        "f_length": F.length(m),
        "f_digits": F.length(digits),
        "f_letters": count(m, "[A-Za-z]"),
        "f_upper": count(m, "[A-Z]"),
        "f_hex": count(m, "[0-9a-fA-F]") / F.length(m),
        "f_seps": count(m, "[ ./_-]"),
        "f_kinds_of_seps": reduce(Column.__add__, [F.contains(m, F.lit(c)).cast("int") for c in SEPARATORS]),
        "f_groups": F.size(groups),
        "f_longest": F.coalesce(F.array_max(sizes), F.lit(0)),
        "f_shortest": F.coalesce(F.array_min(sizes), F.lit(0)),
        "f_luhn": F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False),
        "f_zero": m.rlike("^\\(?0"),
        "f_paren": m.startswith("("),
        "f_brackets": count(m, r"[\[\](){}<>]"),
        "f_colons": count(m, ":"),
        "f_dots": count(m, "[.]"),
        "f_last_word": F.length(F.regexp_extract(m, "([A-Za-z]*)[^A-Za-z]*$", 1)),
        "f_suffix": m.rlike(f"(?i)[^A-Za-z](?:{SUFFIXES})[^A-Za-z]*$"),
        "f_cue": cue,
        "f_other": before.rlike(r"(order|invoice|part|ref|serial|isbn|version|no\.?|id|code|case|sku|build|commit|sha|page|date|section)[^a-z]{0,4}$"),
        "f_assigned": before.rlike("[:=] ?[\"']?$"),
        "f_quoted": before.rlike("[\"'`]$") & after.rlike("^[\"'`]"),
        "f_money": before.rlike("[$€£] ?$"),
        "f_unit": after.rlike("^ ?(%|°|[a-zA-Z]{1,3}\\b)"),
        "f_digits_before": count(before, "[0-9]"),
        "f_digits_after": count(after, "[0-9]"),
        "f_glued": before.rlike("[^\\s(\\[\"'`:=|>]$"),
    }
    return rows.withColumns({k: v.cast("double") for k, v in values.items()})


def training_rows(spark: SparkSession, n: int, first: int = 0, held_out: bool = False) -> DataFrame:
    """n generated texts (id, text, kind, label, at, end): a core at [at, end), personal data of the kind if label is 1, else something that looks like it.

    Every row follows from its number. held_out takes other words around the core, other names and
    other formats of what is not personal.
    """
    pick = lambda salt, k: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(k)).cast("int")
    one = lambda salt, *xs: F.element_at(F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs]), pick(salt, len(xs)) + 1)
    digits = lambda salt, k: F.lpad(F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(10**k)).cast("string"), k, "0")
    hexes = lambda salt, k: F.substring(F.md5(F.concat(F.lit(salt), F.col("id").cast("string"))), 1, k)
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    small = lambda salt, k: pick(salt, k).cast("string")
    sep = one("sep", " ", "-", ".")
    # numbers of cards, with a right and a wrong check digit
    body = cat(one("lead4", "4", "5", "37", "6"), digits("d", 7), digits("e", 6))
    body = F.substring(F.concat(body, digits("f", 3)), 1, 15)
    doubled = F.transform(F.split(body, ""), lambda c, i: F.when(c == "", 0).otherwise(F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))))
    check = (10 - F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10) % 10
    good, wrong = F.concat(body, check.cast("string")), F.concat(body, ((check + 1 + pick("w", 8)) % 10).cast("string"))
    card_sep = one("csep", "-", ".", " ", "/", "_", "  ", " - ")
    grouped = lambda c: F.concat_ws("", F.substring(c, 1, 4), card_sep, F.substring(c, 5, 4), card_sep, F.substring(c, 9, 4), card_sep, F.substring(c, 13, 4))
    names = ("pia", "tomas", "w.okafor", "li_na", "sales") if held_out else ("anna", "john", "maria.b", "lee_x", "omar42", "kim")
    name, host = one("n1", *names), one("h", *(("post", "uni-y", "acme2") if held_out else ("mail", "example", "uni-x", "corp9")))
    dot = one("dot", " [dot] ", " (dot) ", " dot ", ".", "(dot)", " DOT ")
    tld = one("tld", "com", "org", "net", "de", "co")
    byte = lambda salt: small(salt, 256)
    group = lambda salt: hexes(salt, 4)
    phone = one("form", cat("(", digits("a", 3), ") ", digits("b", 3), "-", digits("c", 4)), cat(digits("a", 3), sep, digits("b", 3), sep, digits("c", 4)), cat("0", digits("a", 2), " ", digits("b", 4), " ", digits("c", 4)), cat("00", one("cc", "49", "33", "44", "34"), " ", digits("a", 2), " ", digits("c", 6)), cat("0", digits("a", 3), "/", digits("c", 6)), cat("06 ", digits("p", 2), " ", digits("q", 2), " ", digits("r", 2), " ", digits("s", 2)))
    positives = {
        "email": one("ef", cat(name, one("at", " [at] ", "(at)", " (at) ", "[AT]", " <at> "), host, dot, tld), cat(name, " at ", host, " dot ", tld), cat(name, " @ ", host, ".", tld), cat(name, "@", host, " dot ", tld)),
        "ip": one("if", F.concat_ws(":", *[group(f"g{i}") for i in range(8)]), cat(group("g1"), ":", group("g2"), "::", group("g3")), cat(byte("i1"), "[.]", byte("i2"), "[.]", byte("i3"), "[.]", byte("i4")), cat(byte("i1"), " . ", byte("i2"), " . ", byte("i3"), " . ", byte("i4"))),
        "card": F.when(pick("cf", 4) == 0, good).otherwise(grouped(good)),
        "phone": phone,
        "secret": one("sf", hexes("k", 32), F.concat(hexes("k", 32), hexes("l", 8)), cat("sk_live_", hexes("k", 24)), F.regexp_replace(F.base64(F.encode(hexes("k", 24), "UTF-8")), "=", ""), cat("ghp_", F.base64(F.encode(hexes("l", 27), "UTF-8")))),
    }
    date = cat("20", digits("y", 2), one("ds", "-", ".", " "), F.lpad((pick("mo", 12) + 1).cast("string"), 2, "0"), one("ds", "-", ".", " "), F.lpad((pick("da", 28) + 1).cast("string"), 2, "0"))
    numbers = F.concat_ws(" ", *[small(f"z{i}", 900) for i in range(6)])
    amounts = cat(small("z1", 900), ".", digits("z2", 3), ".", digits("z3", 3))
    negatives = {
        "email": one("en", cat("look at noon dot the"), cat("meet (at) home dot ", one("q", "a", "the", "then")), cat("we stay [at] work. It"), cat(small("z1", 9), " @ ", small("z2", 90), ".", digits("z3", 2)), cat("we look @ this.So")) if not held_out else one("en", cat("arrive at once dot and"), cat("sold (at) cost dot ", one("q", "and", "but")), cat("5 @ 3 . 20")),
        "ip": one("in", cat("12:", digits("z1", 2), ":", digits("z2", 2)), cat("1:2:3:4:5:6:7:8"), cat("std::", one("v", "abs", "add", "fee")), cat(small("z1", 40), " . ", small("z2", 40), " . ", small("z3", 40), " . ")) if not held_out else one("in", cat("0", small("z3", 9), ":", digits("z1", 2), ":", digits("z2", 2), ":00"), cat("a::b"), cat("3 . 4 . 5 . 6")),
        "card": one("cn", wrong, grouped(wrong), F.concat(digits("z1", 8), digits("z2", 9)), cat("978", digits("z1", 10))) if not held_out else one("cn", wrong, cat(digits("z1", 4), "-", digits("z2", 4), "-", digits("z3", 4), "-", digits("z4", 4)), F.concat(date, digits("z1", 8))),
        "phone": one("pn", date, numbers, amounts, cat(date, " ", digits("z1", 2)), cat("0.", digits("z1", 3), " 0.", digits("z2", 3)), cat(digits("a", 3), sep, digits("b", 3), sep, digits("c", 4))) if not held_out else one("pn", cat(date, ".", digits("z5", 2)), F.concat_ws("-", small("z1", 99), small("z2", 99), small("z3", 99)), cat("978-3-", digits("z1", 2), "-", digits("z2", 6), "-1"), numbers),
        "secret": one("sn", cat("internationalization-of-words-2"), F.concat(hexes("k", 32), hexes("l", 8)), cat("/usr/share/lib/python3/dist/packages"), cat(hexes("k", 8), "-", hexes("l", 4), "-4", hexes("m", 3), "-a", hexes("o", 3), "-", hexes("p", 12)), F.repeat(F.lit("0123456789"), 4)) if not held_out else one("sn", cat("one-two-three-four-five-6-seven"), cat("src/main/java/org/app/v2/Handler"), F.concat(hexes("k", 32), hexes("l", 8)), F.repeat(F.lit("10"), 15)),
    }
    lead = one("lead", *(("by the way, ", "as we said ", "| ", "in short: ", "") if held_out else ("we saw that ", "and then ", "in the end, ", "as written ", "", "the list | ")))
    cues = {
        "email": ("drop a line to ", "send it to ", "reach ") if held_out else ("mail ", "contact ", "write to ", ""),
        "ip": ("traffic came from ", "on ", "host ") if held_out else ("from ", "server ", "ip ", "address: ", ""),
        "card": ("charged to ", "paid by ", "carte ") if held_out else ("card ", "visa: ", "payment by card ", ""),
        "phone": ("ring me on ", "text ", "handy ") if held_out else ("call ", "phone: ", "tel ", "mobile ", "fax: ", ""),
        "secret": ('api_key: "', "auth=", 'pwd = "') if held_out else ('token = "', "secret: ", "key=", 'password = "', "Bearer "),
    }
    bad = one("bad", *(("page ", "section ", "on date ", "model ", "$") if held_out else ("order no ", "invoice ", "part no. ", "ref ", "serial ", "sku ", "commit ", "$", "build ", "")))
    kind = one("kind", *ALL_KINDS)
    by_kind = lambda options: reduce(lambda a, k: F.when(kind == k, options[k]).otherwise(a), ALL_KINDS, F.lit(""))
    positive = pick("label", 2) == 1
    core = F.when(positive, by_kind(positives)).otherwise(by_kind(negatives))
    head = F.concat(lead, F.when(positive, by_kind({k: one(f"cue{k}", *v) for k, v in cues.items()})).otherwise(bad))
    tail = one("tail", *((", ok?", " |", '"', " - thanks") if held_out else (" and more.", ".", " today", '"', " 17 and 4")))
    rows = spark.range(first, first + n)
    return rows.select("id", F.concat(head, core, tail).alias("text"), kind.alias("core_kind"), positive.cast("double").alias("positive"), F.length(head).alias("at"), (F.length(head) + F.length(core)).alias("core_end"))


def labelled(rows: DataFrame) -> DataFrame:
    """Candidates of training_rows with label: 1 for the whole core of a personal row under its own kind, else 0."""
    found = candidates(rows, "text", ("id", "core_kind", "positive", "at", "core_end"))
    whole = (F.col("kind") == F.col("core_kind")) & (F.col("start") == F.col("at")) & (F.col("end") == F.col("core_end"))
    return found.withColumn("label", F.when(whole, F.col("positive")).otherwise(0.0))


def _vectorized(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(_features(rows))


Model = tuple[GBTClassificationModel, dict[str, float]]
_FITTED: dict[tuple[str, int, int, float], Model] = {}


def fit(spark: SparkSession, train_rows: int = TRAIN_ROWS, held_out_rows: int = HELD_OUT_ROWS, precision: float = PRECISION) -> Model:
    """Trees fitted on generated rows, and for each kind the least threshold that has the precision on held-out ones. Fitted once a session."""
    key = (spark.sparkContext.applicationId, train_rows, held_out_rows, precision)
    if key in _FITTED:
        return _FITTED[key]
    # features are written first, as fitting reads them many times
    rows = saved(_features(labelled(training_rows(spark, train_rows))).select(*FEATURES, "label"))
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    model = GBTClassifier(maxIter=15, maxDepth=4, seed=7, stepSize=0.3).fit(assembler.transform(rows).select("features", "label").coalesce(1))
    held = saved(_features(labelled(training_rows(spark, held_out_rows, train_rows, held_out=True))).select("id", "kind", "label", *FEATURES))
    likeliest = F.max(F.struct(vector_to_array("probability")[1].alias("p"), "kind", "label")).alias("s")
    best = model.transform(assembler.transform(held)).groupBy("id").agg(likeliest).select(F.floor(F.col("s.p") * 100).alias("p"), "s.kind", "s.label")
    scored = best.groupBy("kind", "p").agg(F.sum("label").alias("hit"), F.count("*").alias("n")).collect()
    thresholds = {}
    for kind in ALL_KINDS:
        threshold, hit, n = 1.01, 0.0, 0
        for row in sorted((r for r in scored if r["kind"] == kind), key=lambda r: -r["p"]):
            hit, n = hit + row["hit"], n + row["n"]
            if hit / n >= precision:
                threshold = row["p"] / 100
        thresholds[kind] = max(threshold, 0.5)
    _FITTED[key] = model, thresholds
    return _FITTED[key]


def _above(thresholds: dict[str, float]) -> Column:
    """Whether a scored candidate reaches the threshold of its kind."""
    return reduce(or_, [(F.col("kind") == k) & (F.col("p") >= t) for k, t in thresholds.items()])


def _apart(spans: Column) -> Column:
    """Of spans (start, end, kind, p) those that overlap no likelier one that stays, in order of start; of equally likely ones the first stays."""
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    likely = F.array_sort(F.transform(spans, lambda s: F.struct((-s["p"]).alias("less"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(kept: Column, s: Column) -> Column:
        meets = F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"]))
        return F.when(meets, kept).otherwise(F.concat(kept, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))

    return F.transform(F.array_sort(F.aggregate(likely, none, step)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """One row for each row of docs: id, text_hash, b_<kind> (base spans) and added (kind, start, end) by the trees.

    Added spans overlap neither base spans nor each other. A null or empty text has no spans;
    texts are searched whole, whatever their length. Rows that repeat an id are told apart by
    their text. An empty table gives an empty result; further columns are left out.
    """
    trees, thresholds = model or fit(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    found = base_spans(rows).drop("text")
    scored = trees.transform(_vectorized(candidates(rows, "text", ("id", "text_hash")))).withColumn("p", vector_to_array("probability")[1])
    chosen = scored.filter(_above(thresholds))
    added = chosen.groupBy("id", "text_hash").agg(F.collect_set(F.struct("start", "end", "kind", "p")).alias("added"))
    joined = found.alias("a").join(added.alias("b"), F.expr("a.id <=> b.id AND a.text_hash = b.text_hash"), "left")
    base = F.concat(*[F.col(f"b_{k}") for k in KINDS])
    apart = _apart(F.filter("added", lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return joined.select(F.col("a.id").alias(id_col), F.col("a.text_hash").alias("text_hash"), *[f"b_{k}" for k in KINDS], F.coalesce(apart, none).alias("added"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "*", model: Model | None = None) -> DataFrame:
    """(id, redacted): each code point under a span becomes mask; a null text is null."""
    found = find_pii(docs, id_col, text_col, model)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).distinct()
    plain = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    spans = F.array_sort(F.concat(*[F.col(f"b_{k}") for k in KINDS], plain(F.col("added"))))
    joined = found.withColumn("spans", spans).alias("f").join(rows.alias("r"), F.expr("f.`" + id_col + "` <=> r.id AND f.text_hash = r.text_hash"))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("upto"))

    def step(a: Column, s: Column) -> Column:
        start, end = F.greatest(s["start"], a["upto"]), F.greatest(s["end"], a["upto"])
        kept = F.substring(F.col("r.text"), a["upto"] + 1, start - a["upto"])
        return F.struct(F.concat(a["out"], kept, F.repeat(F.lit(mask), end - start)).alias("out"), end.alias("upto"))

    done = F.aggregate("spans", zero, step)
    tail = F.substring(F.col("r.text"), F.col("done.upto") + 1, F.length("r.text"))
    return joined.withColumn("done", done).select(F.col(f"f.{id_col}").alias(id_col), F.when(F.col("r.text").isNotNull(), F.concat("done.out", tail)).alias("redacted"))


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.array_join(F.concat(*[_named(k, F.col(f"b_{k}")) for k in KINDS]), ",")
    ends = lambda k: F.transform(F.filter("added", lambda s: s["kind"] == k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    every = F.concat(*[_named(k, F.array_sort(F.concat(F.col(f"b_{k}"), ends(k)))) for k in KINDS], _named("secret", ends("secret")))
    counts = [F.size(f"b_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.size(every).cast("long").alias("n_spans"), F.sha2(F.encode(base, "UTF-8"), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"))
