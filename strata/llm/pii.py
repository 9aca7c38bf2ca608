"""Format-preserving pseudonyms for personal data, by keyed Feistel networks.

A found value is validated (check digits, number plans, calendar), mapped to a
pair of numbers (l, r) from Z_a x Z_b whose product is exactly the set of
valid values of its format, put through ROUNDS keyed rounds
    l += F(round, r) mod a,   r += F(round, l) mod b   (in turn)
and written back in the same format.  A round can be undone, so the map is a
permutation of the format: equal values get equal pseudonyms in every document,
different ones stay different, and no table of values is kept anywhere.

    card      13-19 digits with a right Luhn digit: first digit kept, middle permuted, check digit made anew
    phone     North American numbers (area, exchange, line); other +numbers of 8 to 15 digits, in any groups, keep their first two digits
    ssn       area, group and serial number within their allowed ranges
    ip        the 32 bits of an IPv4 address
    date      the 146,097 days of 1800 to 2199, as Y-M-D, Y/M/D, M/D/Y or M-D-Y (day first if only that is a date) or D.M.Y
    iban      digits after the country code permuted, check digits made anew
    email     characters of the local part, each within its class (letter, digit)
    secret    what follows AKIA, sk_live_, ghp_, Bearer and the like, and password=, token:, ... up to white space or a quote, if it
              has a digit and 4 characters or else 8: letters and digits within their class

Numbers that fail validation stay as they are, and so does all other text; names of months, IPv6 and account numbers with
letters inside are not looked for.  A number that follows a phone number after a blank may count as its last group.
Only DataFrame functions run here: no Python on executors, no shuffle.

Null text stays null, empty text empty; both count no replacement.  Repeated
rows give equal rows.  Other columns pass through.  Empty input: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8
#: stands for a secret that a deployment passes in, as an argument or by the session setting KEY_SETTING
DEFAULT_KEY = "example key"
KEY_SETTING = "spark.strata.pseudonymKey"

# fixed values: formats as regular expressions, tried in this order
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_NAME = r"(?i:password|passwd|passphrase|pwd|token|secret|api_?key)[\"']?\s{0,2}[=:]\s{0,2}[\"']?"
#: what a token says of its kind
_LEAD = r"(?:(?i:bearer)\s{1,2}|(?:sk|pk|rk)_(?:live|test)_|gh[opsur]_)"
PATTERNS = {
    "secret": _NAME + r"(?!(?i:bearer)\s)(?:[^\s\"']{8,}+|(?=[^\s\"']*\d)[^\s\"']{4,}+)|(?<!\w)" + _LEAD + r"(?=[A-Za-z._~+/=-]*\d)[0-9A-Za-z._~+/=-]{8,}+|(?<!\w)AKIA[0-9A-Z]{16}(?!\w)",
    "email": r"(?<![\w.+%-])[\w.+%-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?\d{4}){2,7}(?: ?\d{1,3})?(?!\w)",
    "phone": r"(?<![\w+])(?:\+1[ .-]?)?\(?[2-9]\d{2}(?:\) ?|[ .-])[2-9]\d{2}[ .-]\d{4}(?!\w)|(?<![\w+])\+1[2-9]\d{2}[2-9]\d{6}(?!\w)",
    "intl": r"(?<![\w+])\+[2-9]\d{0,2}(?:[ .-]\d{1,4}){2,5}(?![\w-])|(?<![\w+])\+[2-9]\d{1,2}[ -]?\d{1,5}[ -]?\d{4,9}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "date": r"(?<![\w-])\d{4}-\d{2}-\d{2}(?![\w-])|(?<![\w/])\d{4}/\d{2}/\d{2}(?![\w/])|(?<![\w./-])\d{1,2}([/.-])\d{1,2}\1\d{4}(?![\w/-])",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}([ -])\d{4}\2\d{4}\2\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)",
}
FIND = "|".join(PATTERNS.values())
_EPOCH_1800 = -62091  # days from 1970-01-01 to 1800-01-01


def bind(value: Column, then) -> Column:
    """then(value), with value evaluated once: a lambda variable is not inlined."""
    return F.transform(F.array(value), then)[0]


def noise(key: str, tag: str, i: Column, x: Column) -> Column:
    """60 keyed pseudo-random bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), i.cast("string"), x.cast("string")), 256), 1, 15), 16, 10).cast("bigint")


def feistel(l: Column, r: Column, a, b, key: str, tag: str) -> Column:
    """struct(l, r): the permutation of Z_a x Z_b that key and tag name."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    a, b = a.cast("bigint"), b.cast("bigint")
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
        F.struct(l.cast("bigint").alias("l"), r.cast("bigint").alias("r")),
        lambda p, i: F.when(i % 2 == 0, F.struct(((p["l"] + noise(key, tag, i, p["r"]) % a) % a).alias("l"), p["r"].alias("r")))
        .otherwise(F.struct(p["l"].alias("l"), ((p["r"] + noise(key, tag, i, p["l"]) % b) % b).alias("r"))))


def ten_to(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("bigint")


def permute_digits(d: Column, key: str, tag: str) -> Column:
    """A string of up to 36 digits, permuted among the strings of its length."""
    def of(x):
        half = F.floor(F.length(x) / 2).cast("int")
        rest = F.length(x) - half
        left, right = F.substring(x, F.lit(1), half), F.substring(x, half + 1, rest)
        number = lambda s: F.when(s == "", F.lit(0)).otherwise(s.cast("bigint"))
        return bind(feistel(number(left), number(right), ten_to(half), ten_to(rest), key, tag),
                    lambda p: F.concat(F.lpad(p["l"].cast("string"), half, "0"), F.lpad(p["r"].cast("string"), rest, "0")))
    return bind(d, of)


def write_digits(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order, by those of digits."""
    chars = F.split(shape, "")
    return F.aggregate(chars, F.struct(F.lit("").alias("s"), F.lit(1).alias("i")), lambda acc, c: F.when(
        c.between("0", "9"), F.struct(F.concat(acc["s"], F.substring(digits, acc["i"], F.lit(1))).alias("s"), (acc["i"] + 1).alias("i")))
        .otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["i"].alias("i"))))["s"]


def only_digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def luhn_sum(d: Column) -> Column:
    """Luhn sum of a digit string whose last digit is doubled."""
    return F.aggregate(F.reverse(F.split(d, "")), F.struct(F.lit(0).alias("s"), F.lit(True).alias("twice")), lambda acc, c: F.struct(
        (acc["s"] + F.when(acc["twice"], (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")).otherwise(c.cast("int"))).alias("s"),
        (~acc["twice"]).alias("twice")))["s"]


def card(m: Column, key: str) -> Column:
    def of(d):
        n = F.length(d)
        check = lambda x: ((F.lit(10) - luhn_sum(x) % 10) % 10).cast("string")
        new = bind(F.concat(F.substring(d, 1, 1), permute_digits(F.substring(d, F.lit(2), n - 2), key, "card")), lambda x: F.concat(x, check(x)))
        body = F.substring(d, F.lit(1), n - 1)
        return F.when(F.substring(d, n, F.lit(1)) == check(body), write_digits(m, new)).otherwise(m)
    return bind(only_digits(m), of)


def phone(m: Column, key: str) -> Column:
    def of(d):  # ten digits: 800 areas, 800 exchanges, 10,000 lines
        n = (F.substring(d, 1, 3).cast("bigint") - 200) * 800 + (F.substring(d, 4, 3).cast("bigint") - 200)
        line = F.substring(d, 7, 4).cast("bigint")
        new = bind(feistel(n, line, 640000, 10000, key, "phone"), lambda p: F.concat(
            (F.floor(p["l"] / 800) + 200).cast("string"), (p["l"] % 800 + 200).cast("string"), F.lpad(p["r"].cast("string"), 4, "0")))
        return F.when(m.startswith("+1"), F.concat(F.lit("+1"), write_digits(F.substring(m, F.lit(3), F.length(m)), new))).otherwise(write_digits(m, new))
    return bind(F.right(only_digits(m), F.lit(10)), of)


def intl(m: Column, key: str) -> Column:
    d = only_digits(m)
    new = write_digits(m, F.concat(F.substring(d, 1, 2), permute_digits(F.substring(d, F.lit(3), F.length(d)), key, "intl")))
    return F.when(F.length(d).between(8, 15), new).otherwise(m)


def ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, i, n).cast("bigint") for i, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = F.when(area > 666, area - 2).otherwise(area - 1)  # 898 areas
    return F.when(valid, bind(feistel(index * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn"), lambda p: bind(F.floor(p["l"] / 99), lambda i: F.concat_ws(
        "-", F.lpad((i + F.when(i >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((p["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((p["r"] + 1).cast("string"), 4, "0"))))).otherwise(m)


def ip(m: Column, key: str) -> Column:
    def of(x):
        octet = lambda i: x[i].cast("bigint")
        return bind(feistel(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), 65536, 65536, key, "ip"), lambda p: F.concat_ws(
            ".", *(c.cast("string") for c in (F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256))))
    return bind(F.split(m, r"\."), of)


def date(m: Column, key: str) -> Column:
    def of(x):  # the three fields
        year_first = m.rlike(r"^\d{4}")
        iso_text = lambda y, mo, d: F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0"))
        as_date = lambda y, mo, d: F.try_to_date(iso_text(x[y], x[mo], x[d]), "yyyy-MM-dd")
        by_month = ~m.contains(".") & as_date(2, 0, 1).isNotNull()
        day = F.when(year_first, as_date(0, 1, 2)).when(by_month, as_date(2, 0, 1)).otherwise(as_date(2, 1, 0))
        n = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint") - _EPOCH_1800
        # 189 * 773 = 146097 days make 400 years
        new = bind(feistel(F.floor(n / 773), n % 773, 189, 773, key, "date"), lambda p: F.date_add(
            F.lit("1970-01-01").cast("date"), (p["l"] * 773 + p["r"] + _EPOCH_1800).cast("int")))
        pad = F.length(m) == 10
        field = lambda v: F.when(pad, F.lpad(v.cast("string"), 2, "0")).otherwise(v.cast("string"))
        sep = F.when(m.contains("/"), "/").when(m.contains("."), ".").otherwise("-")
        written = bind(new, lambda v: F.when(year_first, F.concat(F.year(v).cast("string"), sep, field(F.month(v)), sep, field(F.dayofmonth(v)))).when(
            by_month, F.concat(field(F.month(v)), sep, field(F.dayofmonth(v)), sep, F.year(v).cast("string"))).otherwise(
            F.concat(field(F.dayofmonth(v)), sep, field(F.month(v)), sep, F.year(v).cast("string"))))
        return F.when(day.isNotNull() & n.between(0, 146096), written).otherwise(m)
    return bind(F.split(m, "[-/.]"), of)


def mod97(country: Column, digits: Column, check: Column) -> Column:
    """The IBAN number modulo 97, digit by digit."""
    letters = F.concat(*((F.ascii(F.substring(country, i, 1)) - 55).cast("string") for i in (1, 2)))
    return F.aggregate(F.split(F.concat(digits, letters, check), ""), F.lit(0), lambda acc, c: (acc * 10 + c.cast("int")) % 97)


def iban(m: Column, key: str) -> Column:
    country, digits = F.substring(m, 1, 2), only_digits(m)
    check, body = F.substring(digits, 1, 2), F.substring(digits, F.lit(3), F.length(digits))
    valid = mod97(country, body, check) == 1
    new = bind(permute_digits(body, key, "iban"), lambda d: F.concat(F.lpad((F.lit(98) - mod97(country, d, F.lit("00"))).cast("string"), 2, "0"), d))
    return F.when(valid, bind(new, lambda d: write_digits(m, d))).otherwise(m)


def permute_chars(s: Column, key: str, tag: str) -> Column:
    """s with every letter and digit replaced within its class; a Feistel network over the two halves."""
    def shift(part, other, i):
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), i.cast("string"), other), 512)
        # lower-case hexadecimal values stay hexadecimal
        def move(c, first, n, b):
            return F.char(F.ascii(c) - ord(first) + b - F.floor((F.ascii(c) - ord(first) + b) / n) * n + ord(first))
        return bind(stream, lambda h: F.array_join(F.transform(F.split(part, ""), lambda c, j: bind(
            F.conv(F.substring(h, (j % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int"), lambda b: F.when(
                c.between("0", "9"), move(c, "0", 10, b)).when(
                (F.ascii(c) >= 97) & (F.ascii(c) <= 102) & F.lit(tag.endswith("hex")), move(c, "a", 6, b)).when(
                (F.ascii(c) >= 97) & (F.ascii(c) <= 122), move(c, "a", 26, b)).when(
                (F.ascii(c) >= 65) & (F.ascii(c) <= 90), move(c, "A", 26, b)).otherwise(c))), ""))

    def of(x):
        half = F.floor(F.length(x) / 2).cast("int")
        return bind(F.aggregate(
            F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(F.substring(x, F.lit(1), half).alias("l"), F.substring(x, half + 1, F.length(x)).alias("r")),
            lambda p, i: F.when(i % 2 == 0, F.struct(p["l"].alias("l"), shift(p["r"], p["l"], i).alias("r")))
            .otherwise(F.struct(shift(p["l"], p["r"], i).alias("l"), p["r"].alias("r")))), lambda p: F.concat(p["l"], p["r"]))
    return bind(s, of)


def email(m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    return F.concat(permute_chars(F.substring(m, F.lit(1), at - 1), key, "email"), F.substring(m, at, F.length(m)))


def secret(m: Column, key: str) -> Column:
    name = F.regexp_extract(m, f"^(?:{_NAME}|{_LEAD}|AKIA)", 0)
    value = F.substring(m, F.length(name) + 1, F.length(m))
    return F.when(value.rlike("^[0-9a-f]+$") & (name != "AKIA"), F.concat(name, permute_chars(value, key, "secret-hex"))).otherwise(
        F.concat(name, permute_chars(value, key, "secret")))


def pseudonym(m: Column, key: str) -> Column:
    """The replacement of one match."""
    whole = lambda kind: m.rlike(f"^(?:{PATTERNS[kind]})$")
    return (F.when(m.rlike(f"^(?:{_NAME}|{_LEAD})"), secret(m, key))
            .when(m.contains("@"), email(m, key))
            .when(m.startswith("AKIA"), secret(m, key))
            .when(m.rlike("^[A-Z]"), iban(m, key))
            .when(m.rlike(r"^\+[2-9]"), intl(m, key))
            .when(whole("ssn"), ssn(m, key))
            .when(m.rlike(r"^\+1|^\(") | whole("phone"), phone(m, key))
            .when(m.rlike(r"^\d{4}-\d{2}-\d{2}$|^\d{4}/\d{2}/\d{2}$|^\d{1,2}([/.-])\d{1,2}\1\d{4}$"), date(m, key))
            .when(whole("ip"), ip(m, key))
            .otherwise(card(m, key)))


def replaced(text: Column, key: str = DEFAULT_KEY) -> Column:
    """struct(text, n_replaced)."""
    def of(found):
        new = F.transform(found, lambda m: pseudonym(m, key))
        return bind(new, lambda fresh: F.struct(
            F.array_join(F.flatten(F.zip_with(F.split(text, FIND, -1), fresh, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "").alias("text"),
            F.size(F.filter(F.arrays_zip(found.alias("a"), fresh.alias("b")), lambda p: p["a"] != p["b"])).cast("long").alias("n_replaced")))
    return F.when(text.rlike("[0-9@]|(?i:passw|passp|pwd|token|secret|api|bearer)") & text.rlike(FIND), bind(F.regexp_extract_all(text, F.lit(FIND), F.lit(0)), of)).otherwise(
        F.struct(text.alias("text"), F.lit(0).cast("long").alias("n_replaced")))


def pseudonymize(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with personal data in text replaced, and n_replaced.  key: else the session's KEY_SETTING."""
    key = key or docs.sparkSession.conf.get(KEY_SETTING, DEFAULT_KEY)
    others = [c for c in docs.columns if c not in ("text", "n_replaced")]
    out = docs.select(*others, replaced(F.col("text").cast("string"), key).alias("_new"))
    return out.select(*(F.col("_new.text").alias("text") if c == "text" else F.col(c) for c in docs.columns if c != "n_replaced"), F.col("_new.n_replaced").alias("n_replaced"))


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """Every document with its personal data pseudonymised, and the number of replacements."""
    return pseudonymize(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text", "n_replaced")
