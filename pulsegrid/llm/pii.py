"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

Numbers and dates are found by pattern, validated (Luhn, mod 97, octets, calendar, numbering plans) and permuted by
a keyed Feistel network within their own format: a card stays a card with a right check digit, a date a date. The
permutation depends on key, kind and length alone, so equal values get equal pseudonyms in every document, and
different values different ones. The digits and letters of an e-mail's local part are permuted in the same way.

Rounds add HMAC-like SHA-256 values modulo the half's size; a result outside the valid set is permuted again until
it is inside (cycle walking), which keeps the map one-to-one.
"""

from __future__ import annotations

import secrets
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EMAIL = r"(?<![\w.%+-])[\w.%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
IPV4 = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)"
DATE = r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w/-]|\.\d)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
PHONE = r"(?<![\w+])(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\w-])"
#: A space before one of these ends a run of digit groups: another kind of value begins there.
OTHER = r"\d{4}-\d{2}-\d{2}(?!\d)|\d{2}[/.]\d{2}[/.]\d{4}(?!\d)|\d{3}-\d{2}-\d{4}(?!\d)|\d{3}[.-]\d{3}[.-]\d{4}(?!\d)|\d{1,3}\.\d"
CARD = rf"(?<![\w.-])\d(?:(?: (?!{OTHER})|-)?\d){{12,240}}(?![\w-])"
ANY = "|".join((EMAIL, IBAN, IPV4, DATE, SSN, PHONE, CARD))
KINDS = ("email", "iban", "ipv4", "date", "ssn", "phone", "card")

ROUNDS = 10
CHARS = "(?<=.)(?=.)"  # between any two characters
FIRST_DAY, DAYS = "1900-01-01", 73049  # to 2099-12-31: these days are permuted among themselves
EARLIEST, ALL_DAYS = "0001-01-01", 3652059  # to 9999-12-31: and so are all the others
STEPS = 256  # of cycle walking
DEMO_KEY = "example key"  # for the registered queries and tests only
LETTERS, BASE26 = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"


def feistel(left: Column, right: Column, a: Column, b: Column, tweak: Column) -> Column:
    """struct(l, r): left modulo a and right modulo b after alternating keyed additions."""

    def add(to: Column, other: Column, i: Column, size: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", tweak, i.cast("string"), other.cast("string")).cast("binary"), 256)
        return F.pmod(to + F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), size), size)

    def step(x: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(F.when(odd, x["l"]).otherwise(add(x["l"], x["r"], i, a)).alias("l"), F.when(odd, add(x["r"], x["l"], i, b)).otherwise(x["r"]).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def number(digits: Column) -> Column:
    return F.coalesce(F.when(digits != "", digits).cast("long"), F.lit(0).cast("long"))


def power(base: int, n: Column) -> Column:
    """base^n for n of 0 to 18, exactly."""
    table = F.array(*(F.lit(base**i if base**i < 2**62 else 2**62).cast("long") for i in range(19)))
    return F.get(table, n)


def padded(value: Column, n: Column) -> Column:
    return F.when(n == 0, "").otherwise(F.lpad(value.cast("string"), n, "0"))


def permute_digits(digits: Column, tweak: Column, valid=None) -> Column:
    """A string of 1 to 34 digits permuted among the strings of its length (of those that are as valid as it is)."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    own = F.concat_ws("|", tweak, n.cast("string"))

    def once(d: Column) -> Column:
        out = feistel(number(F.left(d, u)), number(F.substr(d, u + 1)), power(10, u), power(10, n - u), own)
        return F.aggregate(F.array(out), F.lit(""), lambda _, x: F.concat(padded(x["l"], u), padded(x["r"], n - u)))

    return once(digits) if valid is None else walk(digits, once, lambda d: valid(d) == valid(digits))


def walk(start: Column, once, inside) -> Column:
    """Apply `once` until `inside` holds.

    STEPS times at most: the least share of values inside is 0.36 (phone numbers outside the plan), so that one value
    in 10^49 would not get there.
    """

    def step(x: Column, _: Column) -> Column:
        moved = F.aggregate(F.array(once(x["v"])), F.struct(x["v"].alias("v"), F.lit(False).alias("done")), lambda _, v: F.struct(v.alias("v"), F.coalesce(inside(v), F.lit(False)).alias("done")))
        return F.when(x["done"], x).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(start.alias("v"), F.lit(False).alias("done")), step)["v"]


def permute_letters(letters: Column, tweak: Column) -> Column:
    """A string of lower-case letters permuted among those of its length, 24 letters at a time."""

    def value(s: Column) -> Column:
        return F.when(s == "", F.lit(0)).otherwise(F.conv(F.translate(s, LETTERS, BASE26), 26, 10).cast("long"))

    def text(v: Column, n: Column) -> Column:
        return F.when(n == 0, "").otherwise(F.translate(F.lower(F.lpad(F.conv(v.cast("string"), 10, 26), n, "0")), BASE26, LETTERS))

    def piece(i: Column) -> Column:
        s = F.substr(letters, i * 24 + 1, F.lit(24))
        n = F.length(s)
        u = F.floor(n / 2).cast("int")
        out = feistel(value(F.left(s, u)), value(F.substr(s, u + 1)), power(26, u), power(26, n - u), F.concat_ws("|", tweak, n.cast("string"), i.cast("string")))
        return F.aggregate(F.array(out), F.lit(""), lambda _, x: F.concat(text(x["l"], u), text(x["r"], n - u)))

    return F.when(letters == "", "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length(letters) - 1) / 24).cast("int")), piece), ""))


def refill(template: Column, digits: Column, letters: Column | None = None) -> Column:
    """The template with its digits, and its letters if given, replaced in order."""

    def step(x: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        letter = c.rlike("^[a-z]$") if letters is not None else F.lit(False)
        put = F.when(digit, F.substr(digits, x["d"] + 1, F.lit(1))).when(letter, F.substr(letters if letters is not None else digits, x["a"] + 1, F.lit(1))).otherwise(c)
        return F.struct(F.concat(x["out"], put).alias("out"), (x["d"] + digit.cast("int")).alias("d"), (x["a"] + letter.cast("int")).alias("a"))

    return F.aggregate(F.split(template, CHARS), F.struct(F.lit("").alias("out"), F.lit(0).alias("d"), F.lit(0).alias("a")), step)["out"]


def only(text: Column, kind: str) -> Column:
    return F.regexp_replace(text, f"[^{kind}]", "")


def luhn_sum(digits: Column, start: int) -> Column:
    """Luhn sum; start 0 leaves the last digit as it is, start 1 doubles it."""
    weigh = lambda d, i: F.when((i + start) % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(F.transform(F.split(F.reverse(digits), CHARS), lambda c, i: weigh(c.cast("int"), i)), F.lit(0), lambda a, x: a + x)


def mod97(text: Column) -> Column:
    """Remainder of an IBAN body's value, letters read as 10 to 35."""
    value = lambda c: F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55)
    return F.aggregate(F.split(text, CHARS), F.lit(0), lambda a, c: F.pmod(a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)))


def _email(m: Column, key: Column) -> Column:
    local = F.lower(F.substring_index(m, "@", 1))
    tweak = F.concat_ws("|", key, F.lit("email"))
    return F.concat(refill(local, permute_digits_or_none(only(local, "0-9"), tweak), permute_letters(only(local, "a-z"), tweak)), F.lit("@"), F.substr(m, F.length(local) + 2))


def permute_digits_or_none(digits: Column, tweak: Column) -> Column:
    """Digits of an e-mail, up to 64 of them: 32 at a time."""
    piece = lambda i: permute_digits(F.substr(digits, i * 32 + 1, F.lit(32)), F.concat_ws("|", tweak, i.cast("string")))
    return F.when(digits == "", "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length(digits) - 1) / 32).cast("int")), piece), ""))


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def replace_valid(m: Column, valid, new, most: int) -> Column:
    """m with new() of its valid runs of whole groups, up to `most` groups each, and the rest as it is; null if none is valid.

    Runs may begin and end at any group. Of valid runs that overlap, the one with most characters is taken, then the first.
    """
    bare = lambda run: F.regexp_replace(run, "^[ -]", "")

    def within(groups: Column) -> Column:
        size = F.size(groups)

        def longest(i: Column) -> Column:
            runs = F.transform(F.sequence(F.least(size - i, F.lit(most)), F.lit(1), F.lit(-1)), lambda n: F.struct(n.alias("n"), bare(F.array_join(F.slice(groups, i + 1, n), "")).alias("run")))
            return F.get(F.filter(runs, lambda r: valid(r["run"])), F.lit(0))

        def fold(best: Column) -> Column:
            def step(x: Column, i: Column) -> Column:
                b, group = F.get(best, i), F.get(groups, i)
                beaten = F.exists(F.slice(best, i + 2, F.greatest(b["n"] - 1, F.lit(0))), lambda other: F.coalesce(F.length(other["run"]) > F.length(b["run"]), F.lit(False)))
                take = b.isNotNull() & ~F.coalesce(beaten, F.lit(False))
                mark = F.when(group.rlike("^[ -]"), F.left(group, F.lit(1))).otherwise("")
                put = F.when(take, F.concat(x["out"], mark, new(b["run"]))).otherwise(F.concat(x["out"], group))
                there = F.struct(put.alias("out"), F.when(take, i + b["n"]).otherwise(i + 1).alias("next"), (x["any"] | take).alias("any"))
                return F.when(i < x["next"], x).otherwise(there)

            start = F.struct(F.lit("").alias("out"), F.lit(0).alias("next"), F.lit(False).alias("any"))
            return let(F.aggregate(F.sequence(F.lit(0), size - 1), start, step), lambda x: F.when(x["any"], x["out"]))

        return let(F.transform(F.sequence(F.lit(0), size - 1), longest), fold)

    return let(F.split(m, "(?=[ -])"), within)


def _iban(m: Column, key: Column) -> Column:
    def valid(run: Column) -> Column:
        plain = F.regexp_replace(run, " ", "")
        body = F.substr(plain, F.lit(5))
        return run.rlike("^[A-Z]{2}[0-9]{2}") & F.length(plain).between(12, 34) & (only(body, "0-9") != "") & (mod97(F.concat(body, F.left(plain, F.lit(4)))) == 1)

    def new(run: Column) -> Column:
        plain = F.regexp_replace(run, " ", "")
        country, body = F.left(plain, F.lit(2)), F.substr(plain, F.lit(5))
        moved = refill(body, permute_digits(only(body, "0-9"), F.concat_ws("|", key, F.lit("iban"), country)))

        def put(_: Column, b: Column) -> Column:
            check = F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
            return refill(run, only(F.concat(check, b), "0-9"))

        return F.aggregate(F.array(moved), F.lit(""), put)

    return replace_valid(m, valid, new, 9)


def _ipv4(m: Column, key: Column) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    size = F.lit(65536)
    out = feistel(F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1)), F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3)), size, size, F.concat_ws("|", key, F.lit("ipv4")))
    high, low = (lambda v: F.floor(v / 256)), (lambda v: v % 256)
    return F.aggregate(F.array(out), F.lit(""), lambda _, x: F.concat_ws(".", high(x["l"]), low(x["l"]), high(x["r"]), low(x["r"])))


def _date(m: Column, key: Column, form: str, swapped: bool = False) -> Column:
    """swapped: day before month, told apart by a day over 12; such dates stay such. Days of 1900 to 2099 stay in those years."""
    date = lambda d: F.date_add(F.lit(EARLIEST).cast("date"), d.cast("int"))
    first = F.datediff(F.lit(FIRST_DAY).cast("date"), F.lit(EARLIEST).cast("date")).cast("long")
    day = F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), F.lit(EARLIEST).cast("date")).cast("long")
    near = lambda d: d.between(first, first + DAYS - 1)
    low, wide = F.when(near(day), first).otherwise(0), F.when(near(day), 271).otherwise(1912)  # 270 * 271 and 1911 * 1912 days
    tweak = F.concat_ws("|", key, F.lit("date"), F.lit(form))

    def once(d: Column) -> Column:
        out = feistel(F.floor((d - low) / wide), (d - low) % wide, wide - 1, wide, tweak)
        return F.aggregate(F.array(out), F.lit(0).cast("long"), lambda _, x: x["l"] * wide + x["r"] + low)

    known = lambda d: d.between(0, ALL_DAYS - 1) & (F.dayofmonth(date(d)) > 12 if swapped else F.lit(True))
    return F.when(known(day), F.date_format(date(walk(day, once, lambda d: known(d) & (near(d) == near(day)))), form))


def _ssn(m: Column, key: Column) -> Column:
    valid = lambda d: ~d.rlike("^(000|666|9)") & (F.substr(d, F.lit(4), F.lit(2)) != "00") & (F.substr(d, F.lit(6)) != "0000")
    digits = only(m, "0-9")
    return F.when(valid(digits), refill(m, permute_digits(digits, F.concat_ws("|", key, F.lit("ssn")), valid)))


def _phone(m: Column, key: Column) -> Column:
    """The ten national digits; a number outside the numbering plan stays outside it."""
    valid = lambda d: d.rlike("^[2-9][0-9]{2}[2-9]")
    digits = only(m, "0-9")
    national = F.right(digits, F.lit(10))
    return refill(m, F.concat(F.left(digits, F.length(digits) - 10), permute_digits(national, F.concat_ws("|", key, F.lit("phone")), valid)))


def _card(m: Column, key: Column) -> Column:
    def valid(run: Column) -> Column:
        digits = only(run, "0-9")
        return F.length(digits).between(13, 19) & (luhn_sum(digits, 0) % 10 == 0)

    def new(run: Column) -> Column:
        digits = only(run, "0-9")
        body = permute_digits(F.left(digits, F.length(digits) - 1), F.concat_ws("|", key, F.lit("card")))
        return F.aggregate(F.array(body), F.lit(""), lambda _, b: refill(run, F.concat(b, F.pmod(-luhn_sum(b, 1), F.lit(10)).cast("string"))))

    return replace_valid(m, valid, new, 19)


def found(m: Column, key: Column) -> Column:
    """struct(kind, new) of a match: kind and new are null if it is not valid."""
    kinds = (
        ("email", m.contains("@"), _email(m, key)),
        ("iban", m.rlike("^[A-Z]{2}"), _iban(m, key)),
        ("ipv4", m.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), _ipv4(m, key)),
        ("date", m.rlike(r"^\d{4}-\d{2}-\d{2}$"), _date(m, key, "yyyy-MM-dd")),
        ("date", m.rlike(r"^(0\d|1[0-2])/\d{2}/\d{4}$"), _date(m, key, "MM/dd/yyyy")),
        ("date", m.rlike(r"^\d{2}/\d{2}/\d{4}$"), _date(m, key, "dd/MM/yyyy", swapped=True)),
        ("date", m.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), _date(m, key, "dd.MM.yyyy")),
        ("ssn", m.rlike(r"^\d{3}-\d{2}-\d{4}$"), _ssn(m, key)),
        ("phone", m.rlike(r"^(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}$"), _phone(m, key)),
    )
    out = None
    for kind, is_it, new in kinds:
        pair = F.struct(F.lit(kind).alias("kind"), new.alias("new"))
        out = F.when(is_it, pair) if out is None else out.when(is_it, pair)
    return out.otherwise(F.struct(F.lit("card").alias("kind"), _card(m, key).alias("new")))


#: Keys of applications on a cluster that set none, by application id; they are never written down.
OWN_KEYS: dict[str, str] = {}


def pii_key(spark: SparkSession) -> str:
    """The secret in the session's spark.pulsegrid.pii.key. Without one there is a warning: sessions on this machine get
    DEMO_KEY, which hides nothing from readers of this file, and those on a cluster a random key of their application, so
    that equal values get equal pseudonyms within it, but not in another one."""
    key = spark.conf.get("spark.pulsegrid.pii.key", None)
    if key:
        return key
    context = spark.sparkContext
    if context.master.startswith("local"):
        warnings.warn("spark.pulsegrid.pii.key is not set: pseudonyms are made with a public key", stacklevel=2)
        return DEMO_KEY
    warnings.warn("spark.pulsegrid.pii.key is not set: pseudonyms are made with a random key of this application", stacklevel=2)
    return OWN_KEYS.setdefault(context.applicationId, secrets.token_hex(32))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text with its valid numbers, dates and e-mail names replaced, n_pii, kinds (a count per kind) and the columns in `keep`.

    A null text stays null with no findings; ids may be null or of any type. Every row is rewritten by itself, however
    often it comes; an empty table gives no rows; other columns are not read. What looks like a number or date but is
    not valid is left as it is. A card number or IBAN may stand among other groups, before and after: of the valid runs
    of groups the longest are taken; several in one row of groups count once in n_pii and kinds.
    An empty key is refused.
    """
    if not key:
        raise ValueError("a key is needed")
    secret = F.lit(key)
    kept = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *(F.col(c).alias(n) for c, n in zip(keep, kept, strict=True)))
    rows = rows.withColumn("_hits", F.when(F.col("_text").rlike("[0-9@]"), F.regexp_extract_all("_text", F.lit(f"({ANY})"), F.lit(1))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("_found", F.transform("_hits", lambda m: found(m, secret)))
    pieces = F.split("_text", f"(?:{ANY})", -1)
    new = F.zip_with("_hits", "_found", lambda m, f: F.coalesce(f["new"], m))
    joined = F.array_join(F.zip_with(pieces, new, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    valid = F.transform(F.filter("_found", lambda f: f["new"].isNotNull()), lambda f: f["kind"])
    rows = rows.select("doc_id", F.when(F.size("_hits") > 0, joined).otherwise(F.col("_text")).alias("text"), F.coalesce(valid, F.array().cast("array<string>")).alias("_kinds"), *kept)
    counts = F.struct(*((F.size("_kinds") - F.size(F.array_remove("_kinds", name))).alias(name) for name in KINDS))
    return rows.select("doc_id", "text", F.size("_kinds").alias("n_pii"), counts.alias("kinds"), *(F.col(n).alias(c) for c, n in zip(keep, kept, strict=True)))
