"""Personal data: format-preserving pseudonyms by keyed Feistel permutations.

A value is found by a pattern, validated (check digits, ranges, calendar) and then permuted within its own format: letters stay letters of their case, digits
digits, punctuation stays, card and bank numbers keep valid check digits, dates stay dates. The permutation depends on the key and
the kind only, so equal values get equal pseudonyms in all documents, and different values different ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from joulemill.llm.registry import query, table
from joulemill.llm.words import bind, free_names

DEMO_KEY = "replace with a secret"  # production runs pass their own
ROUNDS = 8
WALK = 64  # most steps of a cycle walk; at least a third of the walked values are valid, so fewer than 1 in 10^11 walks are longer
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
LOWER_1, UPPER_1 = "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
TEXT = (DIGITS, LOWER, UPPER, LOWER_1, UPPER_1)
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: In order: the first that matches at a place wins. None has a capturing group.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "token": r"(?i:token|secret|password|passwd|api[_-]?key)[\x22\x27]?\s{0,3}[=:]\s{0,3}(?:\x22[^\x22\s]{6,}\x22|\x27[^\x27\s]{6,}\x27|(?=[A-Za-z_+/=-]*\d)[A-Za-z0-9_+/=-]{8,}+(?!@))",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "date": r"(?<![\d.-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])|(?<![\d.])\d{2}\.\d{2}\.\d{4}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)"
    r"|\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]\d)?(?:[ .-]?\d{2,8}){1,5}(?!\d)|\(0?\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)"
    r"|(?<![\p{L}\p{N}.+-])(?:1[ .-])?[2-9]\d{2}[ .-]\d{3}[ .-]\d{4}(?![\p{L}\p{N}]|[.-]\d)|(?<![\p{L}\p{N}.+-])0\d{1,4}(?:[ ./-]\d{2,8}){1,4}(?![\p{L}\p{N}]|[.-]\d)",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}(?: \d{4}){2} \d{4}|\d{4}(?:-\d{4}){2}-\d{4}|\d{4} \d{6} \d{4,5}|\d{4}-\d{6}-\d{4,5})(?!\d)",
    "ip": rf"(?<![\d.]){OCTET}\.{OCTET}\.{OCTET}\.{OCTET}(?!\d|\.\d)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
DAY_0, DAYS_X, DAYS_Y = "1901-01-01", 147, 487  # 147 * 487 days: to 2096-12-31, seven times 28 years; earlier and later spans are as long
LATE, LATE_DAYS = r"^(?:1[3-9]|[23]\d)/", 147 * 295
LATE_MONTH = 146_097 / 4_800 - 12  # such days in a month, on average over the calendar's 400 years
FORMATS = {r"^\d{4}-": "yyyy-MM-dd", r"^\d{2}/": "MM/dd/yyyy", r"^\d{2}\.": "dd.MM.yyyy"}


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digest(key: str, kind: str | Column, i: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind if isinstance(kind, Column) else F.lit(kind), i.cast("string"), half.cast("string")).cast("binary"), 256)


def number(hexes: Column, at, length: int) -> Column:
    return F.conv(F.substring(hexes, at, F.lit(length)), 16, 10).cast("long")


def feistel(x: Column, y: Column, step) -> Column:
    """``step(i, own, other)`` renews one half from the other, in turn. Returns the struct (x, y)."""
    start = F.struct(x.alias("x"), y.alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, lambda a, i: F.struct(a["y"].alias("x"), step(i, a["x"], a["y"]).alias("y")))


def place(alphabet: str, char: Column) -> Column:
    """1 for its first character, 0 where it doesn't hold ``char``."""
    return F.instr(F.lit(alphabet), char)


def shifted(char: Column, by: Column, alphabets: tuple[str, ...]) -> Column:
    """``char`` moved on by ``by`` places in the alphabet that holds it; others stay."""
    out = char
    for a in alphabets:
        out = F.when(place(a, char) > 0, F.substring(F.lit(a), F.pmod(place(a, char) - 1 + by, F.lit(len(a))).cast("int") + 1, F.lit(1))).otherwise(out)
    return out


def permuted(text: Column, key: str, kind: str, alphabets: tuple[str, ...]) -> Column:
    """Feistel permutation of the strings with the pattern of ``text``: each half is moved, character by character, by a digest of the other."""
    half = F.floor(F.length(text) / 2).cast("int")

    def step(i, own, other):
        pad = digest(key, kind, i, other)
        move = lambda j: shifted(F.substring(own, j, F.lit(1)), number(pad, F.pmod(j - 1, F.lit(15)) * 4 + 1, 4), alphabets)
        places = F.when(F.length(own) > 0, F.sequence(F.lit(1), F.length(own))).otherwise(F.array().cast("array<int>"))
        return F.array_join(F.transform(places, move), "")

    done = feistel(F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text)), step)
    return F.concat(done["x"], done["y"])


def walked(value: Column, step, valid) -> Column:
    """Cycle walk: ``step`` is applied once and again until ``valid``, so it permutes the valid values among themselves.

    Each value must be valid itself; then the walk ends there at the latest. Null after more than WALK steps."""
    start = F.struct(value.alias("v"), F.lit(False).alias("done"))
    once = lambda a: let(step(a["v"]), lambda v: F.struct(v.alias("v"), F.coalesce(valid(v), F.lit(False)).alias("done")))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, lambda a, _: F.when(a["done"], a).otherwise(once(a)))
    return let(walk, lambda a: F.when(a["done"], a["v"]))


def luhn_digit(payload: Column) -> Column:
    """Check digit of a string of digits."""
    n = F.length(payload)
    value = lambda j: F.substring(payload, j, F.lit(1)).cast("int") * F.when(F.pmod(n - j, F.lit(2)) == 0, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, j: a + F.when(value(j) > 9, value(j) - 9).otherwise(value(j)))
    return F.pmod(-total, F.lit(10)).cast("string")


def only(digits: Column) -> Column:
    return F.regexp_replace(digits, r"\D", "")


def laid_out(like: Column, digits: Column) -> Column:
    """``digits`` with the separators of ``like``: none, after four and six more, or after every four."""
    gap = F.substring(F.regexp_replace(like, r"\d", ""), 1, 1)
    long = F.concat(F.substring(digits, 1, 4), gap, F.substring(digits, 5, 6), gap, F.substring(digits, F.lit(11), F.length(digits)))
    return F.when(gap == "", digits).when(like.rlike(r"^\d{4}\D\d{6}\D"), long).otherwise(F.btrim(F.regexp_replace(digits, r"(\d{4})", F.concat(F.lit("$1"), gap)), gap))


def card(m: Column, key: str) -> Column:
    digits = only(m)
    payload = F.concat(F.substring(digits, 1, 1), permuted(F.substring(digits, F.lit(2), F.length(digits) - 2), key, "card", (DIGITS,)))
    valid = luhn_digit(F.substring(digits, F.lit(1), F.length(digits) - 1)) == F.right(digits, F.lit(1))
    return F.when(valid & ~digits.rlike(r"^0+$"), laid_out(m, F.concat(payload, luhn_digit(payload))))


def mod97(text: Column) -> Column:
    """Remainder of a bank number with letters read as 10 to 35."""
    value = lambda j: place(DIGITS + UPPER, F.substring(text, j, F.lit(1))) - 1
    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), lambda r, j: F.pmod(r * F.when(value(j) > 9, 100).otherwise(10) + value(j), F.lit(97)).cast("int"))


def iban(m: Column, key: str) -> Column:
    def valid(text: Column) -> Column:
        return let(F.replace(text, F.lit(" "), F.lit("")), lambda t: mod97(F.concat(F.substring(t, F.lit(5), F.length(t)), F.substring(t, 1, 4))) == 1)

    def renewed(plain: Column) -> Column:
        country = F.substring(plain, 1, 2)
        new = permuted(F.substring(plain, F.lit(5), F.length(plain)), key, "iban", (DIGITS, UPPER))
        return let(new, lambda t: F.concat(country, F.lpad((F.lit(98) - mod97(F.concat(t, country, F.lit("00")))).cast("string"), 2, "0"), t))

    last = r" [A-Z0-9]{1,4}$"  # may be a word after a number whose groups are all full
    head = F.regexp_replace(m, last, "")
    found = F.when(valid(m), m).when(m.rlike(last) & valid(head), head)

    def laid(text: Column) -> Column:
        return let(let(F.replace(text, F.lit(" "), F.lit("")), renewed), lambda t: F.when(text.contains(" "), F.btrim(F.regexp_replace(t, "(.{4})", "$1 "))).otherwise(t))

    return let(found, lambda t: F.when(t.isNotNull(), F.concat(laid(t), F.substring(m, F.length(t) + 1, F.length(m)))))


def ip(m: Column, key: str) -> Column:
    part = lambda k: F.element_at(F.split(m, r"\."), k).cast("long")
    done = feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), lambda i, own, other: F.pmod(own + number(digest(key, "ip", i, other), F.lit(1), 8), F.lit(65536)))
    octets = [F.floor(done["x"] / 256), F.pmod(done["x"], F.lit(256)), F.floor(done["y"] / 256), F.pmod(done["y"], F.lit(256))]
    return F.concat_ws(".", *[o.cast("string") for o in octets])


def in_calendar(days: Column) -> Column:
    """Whether so many days from DAY_0 lie in the years 1 to 9999."""
    day = lambda text: F.datediff(F.lit(text).cast("date"), F.lit(DAY_0).cast("date"))
    return days.between(day("0001-01-01"), day("9999-12-31"))


def in_span(kind: str, span: Column) -> Column:
    """Every span of years has a permutation of its own."""
    return F.concat(F.lit(kind), F.when(span == 0, "").otherwise(span.cast("string")))


def spread(n: Column, key: str, kind: str, other: int, valid) -> Column:
    """Permutes whole numbers within their span of DAYS_X * ``other`` numbers, among those that are valid."""
    size = DAYS_X * other

    def moved(n: Column) -> Column:
        span = F.floor(n / size)
        # The halves swap with every round, so the size that the renewed half keeps to swaps, too.
        step = lambda i, own, rest: F.pmod(own + number(digest(key, in_span(kind, span), i, rest), F.lit(1), 8), F.when(i % 2 == 0, DAYS_X).otherwise(other).cast("long"))
        at = F.pmod(n, F.lit(size))
        return let(feistel(F.floor(at / other), F.pmod(at, F.lit(other)), step), lambda h: span * size + h["x"] * other + h["y"])

    return walked(n, moved, valid)


def date(m: Column, key: str) -> Column:
    out = late_day(m, key)
    for pattern, form in FORMATS.items():
        day = F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), F.lit(DAY_0).cast("date")).cast("long")
        moved = let(day, lambda d: F.when(d.isNotNull(), F.date_add(F.lit(DAY_0).cast("date"), spread(d, key, "date", DAYS_Y, in_calendar).cast("int"))))
        out = F.when(m.rlike(pattern) & ~m.rlike(LATE), F.date_format(moved, form)).otherwise(out)
    return out


def late_day(m: Column, key: str) -> Column:
    """dd/MM/yyyy with a day from 13 on permutes among such days, so that no pseudonym can be read as MM/dd/yyyy.

    Without the first twelve days of its months the span has 147 x 295 days; the month of the n-th of them is one of those around n / LATE_MONTH."""
    start = F.lit(DAY_0).cast("date")
    month = lambda d: (F.year(d) - 1901) * 12 + F.month(d)

    def of(n: Column) -> Column:
        """The n-th of the days, as days from DAY_0."""
        near = F.transform(F.sequence(F.lit(-2), F.lit(4)), lambda j: let((F.floor(n / LATE_MONTH) + j).cast("int"), lambda k: F.struct(k.alias("k"), (n + 12 * k).cast("int").alias("n"))))
        day = lambda c: F.date_add(start, c["n"])
        return F.get(F.filter(near, lambda c: (month(day(c)) == c["k"]) & (F.dayofmonth(day(c)) > 12)), F.lit(0))["n"]

    def moved(n: Column) -> Column:
        return F.date_format(let(spread(n, key, "late", LATE_DAYS // DAYS_X, lambda x: in_calendar(of(x))), lambda x: F.date_add(start, of(x))), "dd/MM/yyyy")

    given = F.try_to_timestamp(m, F.lit("dd/MM/yyyy")).cast("date")
    return F.when(m.rlike(LATE), let(let(given, lambda d: (F.datediff(d, start) - 12 * month(d)).cast("long")), lambda n: F.when(n.isNotNull(), moved(n))))


def ssn(m: Column, key: str) -> Column:
    valid = lambda x: ~x.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.when(valid(m), walked(m, lambda x: permuted(x, key, "ssn", (DIGITS,)), valid))


def phone(m: Column, key: str) -> Column:
    """What comes before the number (country, long-distance 1, area 0) stays. The rest walks among the numbers that the patterns find."""
    lead = F.regexp_extract(m, r"^\+\d{1,3}(?=[ .(-])|^\+\d|^1(?=[ .-])|^\(?0|^", 0)
    rest = F.substring(m, F.length(lead) + 1, F.length(m))
    valid = lambda x: let(F.concat(lead, x), lambda t: t.rlike(f"^(?:{PATTERNS['phone']})$") & (t.rlike(r"^\(?0") == m.rlike(r"^\(?0")))
    new = walked(rest, lambda x: permuted(x, key, "phone", (DIGITS,)), valid)
    return F.when(F.length(only(m)).between(F.when(m.startswith("0"), 9).otherwise(8), 15), F.concat(lead, new))


def email(m: Column, key: str) -> Column:
    tail = F.regexp_extract(m, r"\.\p{L}+$", 0)
    return F.concat(permuted(F.substring(m, F.lit(1), F.length(m) - F.length(tail)), key, "email", TEXT), tail)


def token(m: Column, key: str) -> Column:
    lead, tail = F.regexp_extract(m, r"^[A-Za-z_-]+[\x22\x27]?\s{0,3}[=:]\s{0,3}[\x22\x27]?", 0), F.regexp_extract(m, r"[\x22\x27]$", 0)
    value = F.substring(m, F.length(lead) + 1, F.length(m) - F.length(lead) - F.length(tail))
    new = let(value, lambda v: F.when(v.rlike("^[0-9a-f]{16,}$"), permuted(v, key, "token", (HEX,))).otherwise(permuted(v, key, "secret", TEXT)))
    return F.concat(lead, new, tail)


KINDS = {"email": email, "token": token, "iban": iban, "date": date, "ssn": ssn, "phone": phone, "card": card, "ip": ip}


def pseudonym(m: Column, key: str) -> Column:
    """Pseudonym of a match; null where it isn't valid."""
    out = F.lit(None).cast("string")
    for kind in reversed(PATTERNS):
        out = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), KINDS[kind](m, key)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """Every row of ``docs`` with its private values replaced in ``text``, and ``n_private``, how many there were.

    Rows are handled one by one, without any shuffle. A null text stays null with ``n_private`` 0, an empty one empty; texts of any length are
    read whole. Values that look private but fail their check stay as they are; repeated rows get equal results, and an empty table
    gives an empty one. Other columns pass through, whatever their names, but for one named ``n_private``, which is replaced."""
    rest = [c for c in docs.columns if c != "n_private"]
    found, new, done = free_names(rest, "found", "new", "done")
    text = F.when(F.col("text").rlike("[0-9@]|(?i:token|secret|passw|api[_-]?key)"), F.col("text"))
    df = bind(docs.select(*[F.col(f"`{c}`") for c in rest]), **{found: F.regexp_extract_all(text, F.lit(ANY), F.lit(0))})
    df = bind(df, **{new: F.transform(found, lambda m: pseudonym(m, key))})
    parts = F.transform(F.split("text", ANY), lambda part, i: F.concat(part, F.coalesce(F.get(new, i), F.get(found, i), F.lit(""))))
    count = F.coalesce(F.size(F.array_compact(new)), F.lit(0))
    df = bind(df, **{done: F.when(F.size(found) > 0, F.array_join(parts, "")).otherwise(F.col("text")), "n_private": F.greatest(count, F.lit(0)).cast("long")})
    return df.select(*[F.col(done).alias("text") if c == "text" else F.col(f"`{c}`") for c in rest], "n_private")


@query("op1_pii")
def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonymise(table(spark, folder, "documents"), DEMO_KEY).select("doc_id", "text", "n_private")
