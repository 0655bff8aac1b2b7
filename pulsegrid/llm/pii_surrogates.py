"""PII surrogates: keyed, type-consistent replacements (DataFrame functions only).

Mentions are found by one pattern over whole texts and taken apart into components (a
name has a given name and a surname). The canonical form of a component decides its
surrogate, so all mentions of one entity in all documents agree, however formatted:
digits of a phone or card number fill the separators of each mention, letter case
follows the mention. A surrogate keeps its type's format: an e-mail address keeps its
length, punctuation and top-level domain, a valid card number stays valid by its check
digit, an address stays an address, hexadecimal secrets stay hexadecimal, a name keeps
its script (Latin, Cyrillic, Greek or Armenian) and its gender: that which the titles
before it state in the corpus, or none where they differ, so that one given name has one
surrogate under every title. A valid IBAN gets valid check digits.

Collision check: candidates are drawn with a counter under the key; of several entities
with one candidate the first keeps it and the others draw again, as do those whose
candidate is an original value or already given out, until all are distinct. Made-up
names grow with the draws; what a format of fixed length has no room for gets a longer
value from the keyed hash, which holds nothing of the original.

Defined cases: a null text stays null with 0 replacements; texts without mentions stay
as they are; rows with null or repeated ids are treated row by row; an empty table
gives an empty result; other columns pass through ``replace`` as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import fresh, release, stage, table

FEMALE = r"(?:Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|госпожа|г-жа)"
MALE = r"(?:Mr|Herr|Señor|Sr|Monsieur|господин|г-н)"
NEUTRAL = r"(?:Dr|Prof)"
_SECRET = r"[A-Za-z0-9+/_-]"
#: (type, pattern) in order of precedence.
PATTERNS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("secret", rf"(?<!{_SECRET})(?={_SECRET}{{8,}})(?<=(?i:password|passwd|secret|api_key|apikey|token) ?[=:] ?[\"']?){_SECRET}++"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}[A-Z0-9]{10,30}(?![A-Za-z0-9])"),
    ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"),
    ("phone", r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\d)|(?<!\w)\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("card", r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d)"),
    ("name", rf"(?<!\p{{L}})(?:{FEMALE}|{MALE}|{NEUTRAL})\.? \p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+)?"),
)
FOUND = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: Syllables of made-up names by script, and the endings by gender.
SYLLABLES = {
    "latin": ("ba", "de", "fi", "go", "ka", "le", "mi", "no", "pe", "ra", "sa", "te", "vi", "lo", "du", "na"),
    "cyrillic": ("ба", "де", "фи", "го", "ка", "ле", "ми", "но", "пе", "ра", "са", "те", "ви", "ло", "ду", "на"),
    "greek": ("βα", "δε", "φι", "γο", "κα", "λε", "μι", "νο", "πε", "ρα", "σα", "τε", "ζι", "λο", "θυ", "να"),
    "armenian": ("բա", "դե", "ֆի", "գո", "կա", "լե", "մի", "նո", "պե", "րա", "սա", "տե", "վի", "լո", "դու", "նա"),
}
ENDINGS = {
    "latin": {"given_f": ("lia", "nna", "tha", "ria"), "given_m": ("ron", "mas", "bert", "dor"), "given_n": ("ris", "lin", "ren", "vin"), "surname": ("mer", "son", "dal", "vik")},
    "cyrillic": {"given_f": ("лия", "нна", "та", "рия"), "given_m": ("рон", "мас", "берт", "дор"), "given_n": ("рис", "лин", "рен", "вин"), "surname": ("мер", "дал", "вик", "лов")},
    "greek": {"given_f": ("λια", "ννα", "θεα", "ρια"), "given_m": ("ρων", "μας", "δης", "τος"), "given_n": ("ρι", "λιν", "ρεν", "βιν"), "surname": ("μερ", "λακ", "δαλ", "βικ")},
    "armenian": {"given_f": ("լիա", "ննա", "թա", "րիա"), "given_m": ("րոն", "մաս", "բեր", "դոր"), "given_n": ("րիս", "լին", "րեն", "վին"), "surname": ("մեր", "դալ", "վիկ", "լով")},
}
DIGIT_TYPES = ("phone", "card", "ssn")


def _script(canon: Column, script: str) -> Column:
    """Whether made-up names of ``script`` stand for a name; Latin ones for all other scripts too."""
    others = [canon.rlike(rf"\p{{Is{x.title()}}}") for x in SYLLABLES if x != "latin"]
    return ~reduce(lambda a, b: a | b, others) if script == "latin" else canon.rlike(rf"\p{{Is{script.title()}}}")


def mentions(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(FOUND), F.lit(0))


def kind(m: Column) -> Column:
    """Type of a mention, by what it is made of."""
    digits = F.length(F.regexp_replace(m, r"\D", ""))
    return (
        F.when(m.rlike(rf"^(?:{FEMALE}|{MALE}|{NEUTRAL})\.? \p{{Lu}}"), "name")
        .when(m.contains("@"), "email")
        .when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^[+(]") | m.rlike(r"^\d{3}-\d{3}-\d{4}$"), "phone")
        .when(m.rlike(r"^\d[\d -]*$") & (digits >= 13) & (digits <= 19), "card")
        .when(m.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{10,30}$"), "iban")
        .otherwise("secret")
    )


def components(m: Column, k: Column) -> Column:
    """array<struct<kind, raw>>; literal parts have kind ``lit``."""
    part = lambda kd, raw: F.struct(kd.alias("kind"), raw.alias("raw"))
    title = F.regexp_extract(m, r"^(\S+ )", 1)
    first, second = F.regexp_extract(m, r"^\S+ (\p{L}+)", 1), F.regexp_extract(m, r"^\S+ \p{L}+ (\p{L}+)$", 1)
    given = F.when(title.rlike(f"^{FEMALE}"), "given_f").when(title.rlike(f"^{MALE}"), "given_m").otherwise("given_n")
    short = F.array(part(F.lit("lit"), title), part(F.lit("surname"), first))
    full = F.array(part(F.lit("lit"), title), part(given, first), part(F.lit("lit"), F.lit(" ")), part(F.lit("surname"), second))
    return F.when(k != "name", F.array(part(k, m))).when(second == "", short).otherwise(full)


def canonical(k: Column, raw: Column) -> Column:
    return F.when(k.isin(*DIGIT_TYPES), F.regexp_replace(raw, r"\D", "")).when((k == "email") | (k == "surname") | k.startswith("given"), F.lower(raw)).otherwise(raw)


def _luhn_sum(s: Column) -> Column:
    """Sum of the digits that precede a check digit, every second one from the right doubled."""
    return F.aggregate(
        F.transform(F.split(F.reverse(s), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))),
        F.lit(0), lambda a, x: a + x,
    )


def _mod_97(iban: Column) -> Column:
    """The number that an IBAN stands for (from its fifth character on, then the first four; A is 10), modulo 97."""
    digits = F.split(F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4)), "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(digits, F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)


def candidate(key: str, k: Column, canon: Column, counter: int) -> Column:
    """A surrogate canonical form drawn by the key and a counter; names gain a syllable every second round."""
    hx = F.sha2(F.concat_ws("|", F.lit(key), k, canon, F.lit(str(counter))), 512)
    byte = lambda i: F.conv(F.substring(hx, 2 * (i % 60) + 1, 4), 16, 10).cast("int")  # noqa: E731  16 bits
    letters = lambda s, i, n: F.substring(F.lit(s), byte(i) % n + 1, F.lit(1))
    digit = lambda i: letters("0123456789", i, 10)
    lower = lambda i: letters("abcdefghijklmnopqrstuvwxyz", i, 26)
    upper = lambda i: letters("ABCDEFGHIJKLMNOPQRSTUVWXYZ", i, 26)
    by_class = lambda c, i: F.when(c.rlike("[0-9]"), digit(i)).when(c.rlike("[a-z]"), lower(i)).when(c.rlike("[A-Z]"), upper(i)).otherwise(c)
    chars = F.split(canon, "")
    spell = lambda f: F.array_join(F.transform(chars, f), "")
    top = F.length(canon) - F.length(F.substring_index(canon, ".", -1))
    email = spell(lambda c, i: F.when(i >= top, c).otherwise(by_class(c, i)))
    secret = F.when(canon.rlike("^[0-9a-f]+$"), spell(lambda c, i: letters("0123456789abcdef", i, 16)))
    secret = secret.when(canon.rlike("^[0-9A-F]+$"), spell(lambda c, i: letters("0123456789ABCDEF", i, 16))).otherwise(spell(by_class))
    number = spell(lambda c, i: F.when(i == 0, c).otherwise(digit(i)))
    body = F.expr("left(canon, length(canon) - 1)")
    drawn = F.array_join(F.transform(F.split(body, ""), lambda c, i: F.when(i == 0, c).otherwise(digit(i))), "")
    valid = (_luhn_sum(body) + F.expr("right(canon, 1)").cast("int")) % 10 == 0
    card = F.when(valid, F.concat(drawn, ((10 - _luhn_sum(drawn) % 10) % 10).cast("string"))).otherwise(number)
    iban = spell(lambda c, i: F.when(i < 2, c).otherwise(by_class(c, i)))
    checked = F.concat(F.substring(iban, 1, 2), F.lpad((98 - _mod_97(F.concat(F.substring(iban, 1, 2), F.lit("00"), F.substring(iban, 5, 40)))).cast("string"), 2, "0"), F.substring(iban, 5, 40))
    iban = F.when(_mod_97(canon) == 1, checked).otherwise(iban)
    ip = F.concat_ws(".", (byte(F.lit(0)) % 223 + 1).cast("string"), *[(byte(F.lit(2 * j)) % 256).cast("string") for j in (1, 2, 3)])
    out = F.when(k == "email", email).when(k == "iban", iban).when(k == "ip", ip).when(k == "card", card).when(k.isin("phone", "ssn"), number)
    for script in SYLLABLES:
        made = F.concat(*[F.element_at(F.array(*[F.lit(x) for x in SYLLABLES[script]]), byte(F.lit(2 * j)) % 16 + 1) for j in range(4 + counter // 2)])
        for kd, ends in ENDINGS[script].items():
            end = F.element_at(F.array(*[F.lit(x) for x in ends]), byte(F.lit(40)) % len(ends) + 1)
            out = out.when((k == kd) & _script(canon, script), F.concat(made, end))
    return out.otherwise(secret)


def beyond(key: str, k: Column, canon: Column) -> Column:
    """A surrogate for what its format has no room for: longer than the format, from the keyed hash alone."""
    hx = F.sha2(F.concat_ws("|", F.lit(key), k, canon), 512)
    part = lambda i, n: F.substring(hx, i, n)
    digits = F.substring(F.translate(hx, "abcdef", "012345"), F.lit(1), F.length(canon) + 24)
    names = F.translate(part(1, 24), "0123456789", "ghijklmnop")
    for script, letters in (("cyrillic", "абвгдежзиклмнопр"), ("greek", "αβγδεζηθικλμνοπρ"), ("armenian", "աբգդեզէըթժիլխծկհ")):
        names = F.when(_script(canon, script), F.translate(part(1, 24), "0123456789abcdef", letters)).otherwise(names)
    return (
        F.when(k.isin(*DIGIT_TYPES), digits)
        .when((k == "surname") | k.startswith("given"), names)
        .when(k == "email", F.concat(part(1, 24), F.lit("@"), part(25, 8), F.lit(".invalid")))
        .when(k == "iban", F.concat(F.lit("XX00"), F.upper(part(1, 24))))
        .otherwise(part(1, 24))
    )


def surrogates(entities: DataFrame, key: str, max_rounds: int = 40) -> DataFrame:
    """(kind, canon, surrogate) for distinct (kind, canon): no two alike, none an original.

    Each round draws for the entities still without a surrogate; what the key space of a
    format cannot give in ``max_rounds`` draws leaves the format, see ``beyond``.
    """
    known = stage(entities, "entities")
    done, left, n = [], known, 0
    given = lambda: reduce(DataFrame.union, done)
    while True:
        drawn = left.withColumn("s", candidate(key, F.col("kind"), F.col("canon"), n))
        drawn = drawn.join(known.select("kind", F.col("canon").alias("s")), ["kind", "s"], "left_anti")
        if done:
            drawn = drawn.join(given().select("kind", "s"), ["kind", "s"], "left_anti")
        done.append(stage(drawn.groupBy("kind", "s").agg(F.min("canon").alias("canon")).select("kind", "canon", "s"), "surrogates"))
        before, left = left, stage(left.join(done[-1], ["kind", "canon"], "left_anti"), "undrawn")
        if n:
            release(before)
        n += 1
        if not left.take(1):
            break
        if n == max_rounds:
            done.append(left.withColumn("s", beyond(key, F.col("kind"), F.col("canon"))))
            break
    return given().select("kind", "canon", F.col("s").alias("surrogate"))


def render(k: Column, raw: Column, s: Column) -> Column:
    """The surrogate in the format of a mention."""
    nth = lambda i: F.length(F.regexp_replace(F.substring(raw, F.lit(1), i + 1), r"\D", ""))
    digits = F.array_join(F.transform(F.split(raw, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(s, nth(i), F.lit(1))).otherwise(c)), "")
    digits = F.concat(digits, F.substring(s, F.length(F.regexp_replace(raw, r"\D", "")) + 1, F.length(s)))
    cased = F.array_join(F.transform(F.split(s, ""), lambda c, i: F.when(F.substring(raw, i + 1, F.lit(1)).rlike("[A-Z]"), F.upper(c)).otherwise(c)), "")
    name = F.when((raw == F.upper(raw)) & (F.length(raw) > 1), F.upper(s)).otherwise(F.initcap(s))
    return F.when(k == "lit", raw).when(k.isin(*DIGIT_TYPES), digits).when(k == "email", cased).when((k == "surname") | k.startswith("given"), name).otherwise(s)


def replacements(docs: DataFrame, key: str) -> DataFrame:
    """(mention, replacement) for all distinct mentions of all documents."""
    found = stage(docs.select(F.explode(mentions("text")).alias("m")).distinct(), "mentions")
    parts = found.select("m", F.posexplode(components(F.col("m"), kind(F.col("m")))).alias("i", "c")).select("m", "i", "c.kind", "c.raw")
    parts = parts.withColumn("canon", canonical(F.col("kind"), F.col("raw")))
    # a given name is of the gender that its titles state, if they agree
    first = parts.where(F.col("kind").startswith("given")).groupBy("canon").agg(F.count_if(F.col("kind") == "given_f").alias("f"), F.count_if(F.col("kind") == "given_m").alias("m"))
    first = first.select(F.col("canon").alias("name"), F.when((F.col("f") > 0) == (F.col("m") > 0), "given_n").when(F.col("f") > 0, "given_f").otherwise("given_m").alias("gender"))
    parts = parts.join(first, F.col("kind").startswith("given") & (F.col("canon") == F.col("name")), "left")
    parts = stage(parts.select("m", "i", F.coalesce("gender", "kind").alias("kind"), "raw", "canon"), "parts")
    known = surrogates(parts.where("kind <> 'lit'").select("kind", "canon").distinct(), key)
    made = parts.join(known, ["kind", "canon"], "left").withColumn("r", render(F.col("kind"), F.col("raw"), F.col("surrogate")))
    out = made.groupBy("m").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda x: x["r"]), "").alias("r"))
    return stage(out, "replacements")


def replace(docs: DataFrame, key: str = "pulsegrid") -> DataFrame:
    """The columns of ``docs`` with every mention in ``text`` replaced, and ``__replaced``, their number."""
    made = replacements(docs, key)
    th = F.xxhash64("text")
    at = docs.select("doc_id", th.alias("th"), F.posexplode(mentions("text")).alias("i", "m")).distinct()
    r_, id_, th_, count = fresh(docs, "__r", "__id", "__th", "__replaced")
    lists = at.join(made, "m").groupBy("doc_id", "th").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda x: x["r"]).alias(r_))
    lists = stage(lists.withColumnsRenamed({"doc_id": id_, "th": th_}), "lists")
    out = docs.join(lists.hint("shuffle_merge"), docs["doc_id"].eqNullSafe(F.col(id_)) & (th == F.col(th_)), "left")
    pieces = F.split("text", FOUND, -1)
    text = F.array_join(F.zip_with(pieces, F.col(r_), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    text = F.when(F.col(r_).isNull(), F.col("text")).otherwise(text)
    names = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*names, F.coalesce(F.size(r_), F.lit(0)).cast("long").alias(count))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(table(spark, sf_dir, "documents")).select("doc_id", F.col("__replaced").alias("n_replaced"), "text")
