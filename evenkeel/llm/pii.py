"""PII surrogates with Spark expressions only.

One pattern finds emails, secrets, cards (13 to 19 digits that pass Luhn's check), phones, IP addresses, social security
numbers, IBANs and names after a title; in a document that names a person so, the full name and the last name are found
without the title too.  Every entity (kind, canonical form: lower case, digits only where the kind is a number; of a name
each word by itself) gets a surrogate from a keyed SHA-512: numbers keep their format, first digit and Luhn validity; emails
their local part's shape in a reserved domain; secrets their prefix and alphabet; names their gender (by the title),
script, capitals, hyphens and number of words.  A last name has one surrogate, whoever's first name or title stands before.

Distinct entities of a kind keep distinct surrogates, and no surrogate is an entity of the corpus: the table of distinct
entities is checked, those that clash are drawn again with a higher attempt, until none is left.  From ``WIDEN`` attempts on
surrogates grow longer (an IP address becomes one of the documentation prefix of version 6), so there is always room; after
``MOST`` attempts an error is raised.  Equal entities get equal surrogates in all documents.  Only rows with an entity are
stored and joined, by a number of their own.

Null and empty texts stay as they are.  Repeated rows repeat.  An empty table gives no rows.  All columns but the text pass
through unchanged, whatever their names; ``n_entities`` is replaced if it is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .util import drop_table, write_table

WIDEN, MOST = 6, 60  # draws after which all kinds grow longer (names and emails do with each), and the most draws
# Titles that tell a gender, in Latin and Cyrillic script.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Signor", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Signora", "Госпожа")
SYLLABLES = {"latin": "ba be bi bo da de di do fa fe ga go ha ka ke ko la le li lo ma me mi mo na ne no ra re ri ro sa se ta te to va ve vi za".split(), "cyrillic": "ба бе би бо да де ди до га го ка ке ко ла ле ли ло ма ме ми мо на не но ра ре ри ро са се та те то ва ве ви за".split()}
ENDINGS = {("latin", "m"): "n", ("latin", "f"): "na", ("cyrillic", "m"): "н", ("cyrillic", "f"): "на"}

_TITLES = "|".join(sorted([*MALE, *FEMALE], key=len, reverse=True))
_KEYS = "(?i:password|passwd|token|secret|api_key|apikey)"  # in any case; what follows is taken to its end
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@(?:[A-Za-z0-9\-]{1,63}+\.){1,8}[A-Za-z]{2,24}",
    "secret": rf"\bAKIA[0-9A-Z]{{16}}\b|\b{_KEYS}\s?[=:]\s?\"?[A-Za-z0-9_\-+/]{{8,}}+\"?|\b(?:sk|ghp|xoxb)[_\-][A-Za-z0-9]{{16,}}+[A-Za-z0-9_\-]*+",
    "phone": r"\+\d{1,3}[ .\-]?\(?\d{2,4}\)?(?:[ .\-]?\d{2,4}){2,3}(?!\d)|(?<![\d+])\(\d{3}\) ?\d{3}-\d{4}(?!\d)",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<![\d.])\d(?:[ \-]?\d){12,18}(?!\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
}
# A word of a name, with hyphens and apostrophes; then a name: initials, words, and small words between them.
_WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{L}{1,40}+(?:['’\-]\p{L}{1,40}+)*+"
_NAME = rf"(?:\p{{Lu}}\. ?){{0,2}}{_WORD}(?: (?:(?:van|von|de|da|di|del|la|le|bin|al) ){{0,2}}(?:\p{{Lu}}\. )?{_WORD}){{0,3}}"
#: A name is found with its title, which says its gender.
_NAMED = rf"(?<!\p{{L}})(?:{_TITLES})\.? {_NAME}"
ALL = "|".join(f"(?:{p})" for p in [*PATTERNS.values(), _NAMED])
#: What any entity must hold, to pass by most texts quickly.
HINT = rf"[0-9@]|\b{_KEYS}\s?[=:]|\bAKIA|\b(?:sk|ghp|xoxb)[_\-]|(?<!\p{{L}})(?:{_TITLES})\.? \p{{Lu}}"
_NUMBERS = ("phone", "ssn", "card")


def kind_of(found: Column) -> Column:
    """The kind of a match; `none` for digits that are no card's."""
    digits = F.regexp_replace(found, r"\D", "")
    out = F.when(found.rlike(f"^(?:{PATTERNS['email']})$"), "email").when(found.rlike(f"^(?:{PATTERNS['secret']})$"), "secret").when(found.rlike(f"^(?:{_NAMED})$"), "name")
    for kind in ("phone", "ip", "ssn"):
        out = out.when(found.rlike(f"^(?:{PATTERNS[kind]})$"), kind)
    out = out.when(found.rlike(f"^(?:{PATTERNS['card']})$"), F.when(F.pmod(luhn_sum(digits), F.lit(10)) == 0, "card").otherwise("none"))
    return out.when(found.rlike(f"^(?:{PATTERNS['iban']})$"), "iban").otherwise("name")


def _title(found: Column) -> Column:
    return F.regexp_extract(found, rf"^(?:{_TITLES})\.? ", 0)


def _bare(found: Column) -> Column:
    return F.substr(found, F.length(_title(found)) + 1)


def mentions(text: Column, found: Column) -> Column:
    """``found`` in ``text``, with the full and last names of those whom it names by title."""
    named = F.transform(F.filter(found, lambda x: _title(x) != ""), _bare)
    last = F.transform(named, lambda x: F.regexp_extract(x, rf"{_WORD}$", 0))
    known = F.array_sort(F.array_distinct(F.concat(named, last)), lambda a, b: F.length(b) - F.length(a))
    quoted = F.array_join(F.transform(known, lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E"))), "|")
    return F.when(F.size(named) > 0, F.concat(F.lit(ALL + r"|(?<![\p{L}\p{N}])(?:"), quoted, F.lit(r")(?![\p{L}\p{N}])")))


def canonical(kind: Column, found: Column) -> Column:
    """What entities of one kind are told apart by; for a name: script and word, of each of its words with a capital."""
    script = lambda w: F.when(w.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    words = F.filter(F.regexp_extract_all(_bare(found), F.lit(r"\p{L}+"), F.lit(0)), lambda w: w.rlike(r"^\p{Lu}"))
    words = F.transform(words, lambda w: F.concat(script(w), F.lit("/"), F.lower(w)))
    other = F.when(kind.isin(*_NUMBERS), F.regexp_replace(found, r"\D", "")).when(kind == "email", F.lower(found)).when(kind == "iban", F.replace(found, F.lit(" "), F.lit(""))).otherwise(found)
    return F.when(kind == "name", words).when(kind == "none", F.array().cast("array<string>")).otherwise(F.array(other))


def _byte(h: Column, i: Column) -> Column:
    return F.conv(F.substr(h, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _shape(h: Column, text: Column, hexadecimal: Column | None = None) -> Column:
    """Letters for letters of the same case, digits for digits, the rest as it is."""

    def each(c: Column, i: Column) -> Column:
        b = _byte(h, i)
        plain = F.when(c.rlike("[0-9]"), F.pmod(b, F.lit(10)).cast("string")).when(c.rlike("[a-z]"), F.char(F.pmod(b, F.lit(26)) + 97)).when(c.rlike("[A-Z]"), F.char(F.pmod(b, F.lit(26)) + 65)).otherwise(c)
        return plain if hexadecimal is None else F.when(hexadecimal & c.rlike("[0-9a-f]"), F.lower(F.hex(F.pmod(b, F.lit(16)).cast("bigint")))).otherwise(plain)

    return F.array_join(F.transform(F.split(text, ""), each), "")


def luhn_sum(digits: Column) -> Column:
    """Sum of Luhn's digits, the last of which is not doubled."""

    def each(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(F.pmod(F.length(digits) - i, F.lit(2)) == 0, 2).otherwise(1)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.split(digits, ""), each), F.lit(0), lambda a, x: a + x)


def draw(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The surrogate of an entity's canonical form; of a name's word, without the ending that tells a gender."""
    h = F.sha2(F.concat_ws("\x01", F.lit(key), kind, canon, attempt.cast("string")), 512)
    more = F.greatest(attempt - WIDEN, F.lit(0))
    each = F.transform(F.sequence(F.lit(2), F.length(canon) + more), lambda i: F.pmod(_byte(h, i), F.lit(10)).cast("string"))
    digits = F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.array_join(each, ""))
    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    check = F.pmod(10 - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    octet = lambda i: (F.pmod(_byte(h, F.lit(i)), F.lit(254)) + 1).cast("string")
    ip = F.when(more > 0, F.concat_ws(":", F.lit("2001:db8"), *[F.substr(h, F.lit(4 * i + 1), F.lit(4)) for i in range(6)])).otherwise(F.concat_ws(".", octet(0), octet(1), octet(2), octet(3)))
    local = F.concat(_shape(h, F.substring_index(canon, "@", 1)), F.when(attempt > 0, F.substr(h, F.lit(20), attempt * 2)).otherwise(""))
    domain = F.element_at(F.array(F.lit("example.com"), F.lit("example.net"), F.lit("example.org")), F.pmod(_byte(h, F.lit(63)), F.lit(3)) + 1)
    prefix = F.regexp_extract(canon, r'^(?:AKIA|(?:sk|ghp|xoxb)[_\-]|[A-Za-z_]+\s?[=:]\s?"?)', 0)
    secret = F.substr(canon, F.length(prefix) + 1)
    longer = F.substr(h, F.lit(60), more)
    mark = F.when(secret.endswith('"'), '"').otherwise("")
    secret = F.rtrim(secret, F.lit('"'))
    secret = F.concat(prefix, _shape(h, secret, secret.rlike("^[0-9a-f]+$")), longer, mark)
    iban = F.concat(F.substr(canon, F.lit(1), F.lit(2)), _shape(h, F.substr(canon, F.lit(3))), F.upper(longer))
    word = None
    for script, pool in SYLLABLES.items():
        pool_ = F.array(*[F.lit(x) for x in pool])
        made = F.array_join(F.transform(F.sequence(F.lit(0), attempt + 2), lambda j: F.element_at(pool_, F.pmod(_byte(h, j), F.lit(len(pool))) + 1)), "")  # noqa: B023
        test = F.substring_index(canon, "/", 1) == script
        word = F.when(test, made) if word is None else word.when(test, made)
    return F.when(kind == "email", F.concat(local, F.lit("@"), domain)).when(kind == "secret", secret).when(kind == "ip", ip).when(kind == "card", F.concat(body, check)).when(kind.isin("phone", "ssn"), digits).when(kind == "iban", iban).otherwise(word)


def render(kind: Column, found: Column, owner: Column, made: Column) -> Column:
    """Surrogates (``made``: one, or one for each word of a name) in the format in which the entity stood."""
    surrogate = F.get(made, F.lit(0))
    at = lambda i: F.length(F.regexp_replace(F.substr(found, F.lit(1), i + 1), r"\D", ""))
    filled = F.array_join(F.transform(F.split(found, ""), lambda c, i: F.when(c.rlike(r"\d"), F.substr(surrogate, at(i), F.lit(1))).otherwise(c)), "")
    filled = F.concat(filled, F.substr(surrogate, at(F.length(found)) + 1))
    grouped = F.when(found.contains(" "), F.trim(F.regexp_replace(surrogate, "(.{4})", "$1 "))).otherwise(surrogate)
    name = _bare(found)
    words, between = F.regexp_extract_all(name, F.lit(r"\p{L}+"), F.lit(0)), F.split(name, r"\p{L}+", -1)
    male = F.regexp_replace(_title(owner), r"\.? $", "").isin(*MALE)

    def word(w: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(words, F.lit(1), i), lambda x: x.rlike(r"^\p{Lu}")))
        own = F.get(made, before)
        ending = F.when(own.rlike(r"\p{IsCyrillic}"), F.when(male, ENDINGS["cyrillic", "m"]).otherwise(ENDINGS["cyrillic", "f"])).otherwise(F.when(male, ENDINGS["latin", "m"]).otherwise(ENDINGS["latin", "f"]))
        own = F.concat(own, ending)
        own = F.when(F.length(w) == 1, F.upper(F.substr(own, F.lit(1), F.lit(1)))).when(w == F.upper(w), F.upper(own)).otherwise(F.initcap(own))
        return F.concat(F.get(between, i), F.when(w.rlike(r"^\p{Lu}"), own).otherwise(w))

    named = F.concat(_title(found), F.array_join(F.transform(words, word), ""), F.element_at(between, -1))
    return F.when(kind == "none", found).when(kind.isin(*_NUMBERS), filled).when(kind == "name", named).when(kind == "iban", grouped).otherwise(surrogate)


def _real(kind: Column, canon: Column) -> Column:
    """What no surrogate of the kind may be: the entity; of a name's word, also what would give it with an ending."""
    word = F.substring_index(canon, "/", -1)
    roots = F.array(word, *[F.when(word.endswith(e), F.substr(word, F.lit(1), F.length(word) - len(e))) for e in ENDINGS.values()])
    return F.when(kind == "name", F.array_compact(roots)).otherwise(F.array(canon))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) of distinct entities, free of clashes, as a stored table; ``entities``: kind, canon."""
    spark = entities.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = entities.repartition(parts, "kind", "canon").distinct().withColumn("attempt", F.lit(0))
    state, path = write_table(drawn.withColumn("surrogate", draw(key, F.col("kind"), F.col("canon"), F.col("attempt"))), "surrogates")
    real, real_path = write_table(state.select("kind", F.explode(_real(F.col("kind"), F.col("canon"))).alias("surrogate")).distinct(), "real")
    for _ in range(MOST):
        order = Window.partitionBy("kind", "surrogate").orderBy("attempt", "canon")
        clash = state.withColumn("again", F.row_number().over(order) > 1)
        clash = clash.join(real.withColumn("real", F.lit(True)), ["kind", "surrogate"], "left").where("again or real").select("kind", "canon").distinct()
        clash, clash_path = write_table(clash, "clashes")
        left = clash.count()
        if left:
            marked = state.join(clash.withColumn("clash", F.lit(True)), ["kind", "canon"], "left")
            next_ = F.when(F.col("clash"), F.col("attempt") + 1).otherwise(F.col("attempt"))
            moved = marked.withColumn("attempt", next_).withColumn("surrogate", F.when(F.col("clash"), draw(key, F.col("kind"), F.col("canon"), F.col("attempt"))).otherwise(F.col("surrogate")))
            new, new_path = write_table(moved.select("kind", "canon", "attempt", "surrogate"), "surrogates")
            drop_table(spark, path)
            state, path = new, new_path
        drop_table(spark, clash_path)
        if not left:
            drop_table(spark, real_path)
            return state.select("kind", "canon", "surrogate"), path
    raise RuntimeError(f"{left} surrogates still clash after {MOST} draws")


def replace_entities(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the entities of its text column replaced, and their number in ``n_entities``."""
    spark, columns = docs.sparkSession, [c for c in docs.columns if c != "n_entities"]
    # the columns go in a struct, so that none can clash with what is added here
    rows = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"), docs[text_col].alias("text"))
    hit = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    bearing = rows.where(hit).withColumn("found", F.regexp_extract_all("text", F.lit(ALL), F.lit(0))).where(F.size("found") > 0)
    bearing = bearing.withColumn("pattern", mentions(F.col("text"), F.col("found")))
    again = F.when(F.col("pattern").isNotNull(), F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).otherwise(F.col("found"))
    bearing, _ = write_table(bearing.withColumn("found", again).withColumn("uid", F.monotonically_increasing_id()), "bearing")
    once = bearing.select("uid", "found", F.posexplode("found").alias("place", "entity"))
    owner = F.coalesce(F.get(F.filter("found", lambda n: (_title(n) != "") & n.endswith(F.col("entity"))), F.lit(0)), F.col("entity"))
    once = once.select("uid", "place", "entity", owner.alias("owner")).withColumn("kind", kind_of(F.col("entity")))
    spots, spots_path = write_table(once.withColumn("canons", canonical(F.col("kind"), F.col("entity"))), "spots")
    each = spots.select("uid", "place", "kind", F.posexplode("canons").alias("at", "canon"))
    made, made_path = surrogates(each.select("kind", "canon"), key)
    got = each.join(made, ["kind", "canon"]).groupBy("uid", "place").agg(F.array_sort(F.collect_list(F.struct("at", "surrogate")))["surrogate"].alias("made"))
    new = render(F.col("kind"), F.col("entity"), F.col("owner"), F.coalesce("made", F.array().cast("array<string>")))
    filled = spots.join(got, ["uid", "place"], "left").withColumn("new", new)
    lists = filled.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("place", "new")))["new"].alias("news"), F.sum((F.col("kind") != "none").cast("bigint")).alias("n_entities"))
    lists, _ = write_table(lists, "lists")
    for p in (spots_path, made_path):
        drop_table(spark, p)
    parts = F.split("text", F.coalesce("pattern", F.lit(ALL)), -1)
    whole = F.array_join(F.zip_with(parts, "news", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    own = [F.col("row")[c].alias(c) for c in columns]
    done = bearing.join(lists, "uid").select(*[whole.alias(c) if c == text_col else x for c, x in zip(columns, own)], "n_entities")
    rest = rows.where(~hit | ~F.coalesce(F.col("text").rlike(ALL), F.lit(False))).select(*own, F.lit(0).cast("bigint").alias("n_entities"))
    return rest.unionByName(done)
