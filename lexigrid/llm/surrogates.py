"""PII surrogates (DataFrame and SQL functions only).

One regular expression finds all entities; a text is split at them and joined
again with surrogates in their places. Names are found by a title; where one was
found, later mentions of it without a title, or of its family name alone, are
mentions too. A surrogate is drawn from a keyed digest of the entity's type, its
canonical form and an attempt number, so that all mentions of one entity get one
surrogate, without a join, and it keeps the entity's format: digits stay digits,
letters keep case and script, separators and lengths stay, card numbers and IBANs stay
valid or invalid, addresses of one mail domain stay in one domain, names keep titles.

Collision checks run on distinct entities: where two entities would share a
surrogate, or a surrogate is itself an entity of the corpus, the later ones move
on to the next attempt until all are distinct. A name's gender is settled there too,
from all of its titles. Only what differs from the first draw (few rows) is joined
back to documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm._shared import cut, table

#: The key of the production query. A real run passes a secret one.
KEY = "lexigrid-demo-key"
#: Draws after which surrogates get longer, so that they cannot run out, and draws after which a bug must be the reason.
LONGER, MAX_ATTEMPTS = 6, 200

#: Titles by gender. They mark the names that follow.
TITLES_F = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Doña", "Госпожа", "Κυρία")
TITLES_M = ("Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
TITLES_N = ("Dr", "Prof", "Mx")
#: Given names by script and gender (n: not known, or both).
GIVEN = {
    "latin_f": ("Alice", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia", "Laura", "Marta", "Nora", "Olga", "Paula", "Rosa", "Vera"),
    "latin_n": ("Alex", "Casey", "Charlie", "Jamie", "Jordan", "Kim", "Luca", "Max", "Morgan", "Noa", "Quinn", "Riley", "Robin", "Sam", "Sasha", "Taylor"),
    "latin_m": ("Adam", "Bruno", "Carl", "Daniel", "Erik", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Leo", "Martin", "Oscar", "Paul", "Simon", "Victor"),
    "cyrillic_f": ("Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга"),
    "cyrillic_n": ("Валя", "Женя", "Саша", "Слава"),
    "cyrillic_m": ("Андрей", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Максим", "Олег"),
    "greek_f": ("Άννα", "Ελένη", "Ειρήνη", "Ζωή", "Μαρία", "Σοφία", "Χριστίνα", "Δήμητρα"),
    "greek_n": ("Άλεξ", "Κιμ", "Ρόμπιν", "Σάσα"),
    "greek_m": ("Αλέξης", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος", "Σπύρος", "Στέφανος"),
}
#: Syllables of family names by script. Four of them give 65,536 names, and each further LONGER draws one more.
SYLLABLES = {
    "latin": ("bar", "bel", "cor", "dan", "fal", "gar", "hol", "ker", "lan", "mar", "nor", "pel", "ros", "sel", "tor", "ven"),
    "cyrillic": ("бар", "бел", "вор", "гал", "дан", "зор", "кол", "лан", "мар", "нор", "пол", "рад", "сол", "тар", "хор", "чер"),
    "greek": ("βαρ", "γαλ", "δαν", "ζαρ", "καλ", "λαν", "μαρ", "ναρ", "παλ", "ραν", "σαλ", "ταρ", "φαν", "χαλ", "ψαρ", "θαν"),
}
#: Alphabets from which letters are replaced by letters of their own kind.
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "àâçèéêëîïñòóôùûü", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω")

_TITLE = "(?:" + "|".join(TITLES_F + TITLES_M + TITLES_N) + r")\.?"
#: A capitalised word with further capitals inside it or after hyphens and apostrophes, or an initial with its stop.
_NAME_WORD = r"(?:\p{Lu}\.(?:-?\p{Lu}\.)*|\p{Lu}[\p{L}\p{M}'’-]+)"
#: Type and pattern; where two begin at one place, the first is taken.
PATTERNS = (
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-](?:[\p{L}\p{N}._%+-]*+)@[\p{L}\p{N}](?:[\p{L}\p{N}-]*+)(?:\.[\p{L}\p{N}-]++)+"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("card", r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])"),
    (
        "phone",
        r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\w)|(?<![\w+])\+\d{8,15}(?!\w)"
        r"|(?<![\w+])(?=\+(?:[ .-]?\(?\d\)?){8,15}(?!\w|[ .-]\d))\+\d{1,3}(?:[ .-]\(?\d{1,12}\)?)+",
    ),
    ("name", rf"\b{_TITLE} {_NAME_WORD}(?: {_NAME_WORD})*+"),
)
PATTERN = "|".join(f"(?:{p})" for _, p in PATTERNS)


#: What a text with an entity has: an @, two digits side by side, or a title before a capital. Most texts have none of it,
#: and most of those are told by patterns that begin with a plain class of characters.
_DIGITS, _MAYBE_TITLE = "[0-9][0-9]", "[" + "".join(sorted({t[0] for t in TITLES_F + TITLES_M + TITLES_N})) + r"]\p{L}{1,9}\.? \p{Lu}"
_TITLED = rf"\b{_TITLE} \p{{Lu}}"
_PERSON = "array<struct<entity:string,kind:string,canon:string,gender:string>>"


def _in(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _once(value: Column, then) -> Column:
    """``then`` of a value that is worked out once."""
    return F.transform(F.array(value), then)[0]


def kind_of(entity: Column) -> Column:
    out = F.when(F.contains(entity, F.lit("@")), "email")
    for kind, pattern in PATTERNS[1:]:
        out = out.when(entity.rlike(f"^(?:{pattern})$"), kind)
    return out.when(entity.rlike(r"^\p{L}"), "name").otherwise("card")


def canonical(entity: Column, kind: Column) -> Column:
    """What mentions of one entity have in common: letter case and separators don't count; a phone's country code and a name's title neither."""
    letters = F.lower(entity)
    bare = F.upper(F.regexp_replace(entity, r"[^\p{L}\p{N}]", ""))
    local = F.regexp_replace(F.regexp_replace(entity, r"^\+\d{1,3}(?=[ .(-])", ""), r"\D", "")
    name = F.regexp_replace(entity, rf"^{_TITLE} ", "")
    return F.when(kind == "email", letters).when(kind == "ip", entity).when(kind == "phone", local).when(kind == "name", name).otherwise(bare)


def title_of(entity: Column) -> Column:
    return F.regexp_extract(entity, rf"^({_TITLE}) ", 1)


def gender_of(entity: Column) -> Column:
    """f or m by a name's title, n where it says nothing."""
    bare = F.regexp_replace(title_of(entity), r"\.$", "")
    return F.when(F.array_contains(_in(TITLES_F), bare), "f").when(F.array_contains(_in(TITLES_M), bare), "m").otherwise("n")


def _hex(key: str, kind: Column, what: Column, attempt: Column, parts: int = 4) -> Column:
    """Hex digits, 64 for each part, that depend on the key, the type, the canonical form and the attempt."""
    part = lambda n: F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(str(n)), kind, what, attempt.cast("string")).cast("binary"), 256)
    return F.concat(*[part(n) for n in range(parts)])


def _byte(digest: Column, at: Column) -> Column:
    """A number from 0 to 255, the same for the same place; places repeat after 128."""
    return F.conv(F.substring(digest, F.pmod(at, F.lit(128)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _digit(digest: Column, at: Column) -> Column:
    return (_byte(digest, at) % 10).cast("string")


def _letter(digest: Column, c: Column, at: Column) -> Column:
    """A letter of the same alphabet and case."""
    low, n = F.lower(c), _byte(digest, at)
    of = lambda letters: F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1))
    out = F.when(low.rlike("^[a-z]$"), of(ALPHABETS[0]))
    for kind, letters in (("[а-яё]", ALPHABETS[2]), ("[α-ωά-ώ]", ALPHABETS[3]), (r"\p{L}", ALPHABETS[1])):
        out = out.when(low.rlike(f"^{kind}$"), of(letters))
    return F.when(c == low, out).otherwise(F.upper(out))


def _chars(text: Column, digest: Column, letters: bool = True) -> Column:
    """Replace digits (and letters) one by one, by their place among the letters and digits, counted from the end: separators don't count."""

    def one(i: Column) -> Column:
        c, left = F.substring(text, i, F.lit(1)), F.length(F.regexp_replace(F.substring(text, i, F.length(text)), r"[^\p{L}\p{Nd}]", ""))
        out = F.when(c.rlike(r"^\p{Nd}$"), _digit(digest, left))
        return (out.when(c.rlike(r"^\p{L}$"), _letter(digest, c, left)) if letters else out).otherwise(c)

    return F.when(F.length(text) == 0, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), ""))


def _luhn(digits: Column) -> Column:
    """The check sum, 0 for a valid number."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 1, F.when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2)).otherwise(value(i))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + doubled(i)) % 10


def _mod97(iban: Column) -> Column:
    """The remainder of an IBAN without separators; 1 for a valid one."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda acc, v: F.when(v < 10, acc * 10 + v).otherwise(acc * 100 + v) % 97
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: value(F.substring(turned, i, F.lit(1)))), F.lit(0), step)


def _bare(entity: Column) -> Column:
    return F.regexp_replace(entity, r"[^\p{L}\p{Nd}]", "")


def _iban(entity: Column, d: Column) -> Column:
    """Country, check digits, account: the check digits are worked out, and are off by as much as they were."""
    drawn = F.concat(F.substring(entity, 1, 4), _chars(F.substring(entity, F.lit(5), F.length(entity)), d))

    def checked(body: Column) -> Column:
        right = 98 - _mod97(F.concat(F.substring(entity, 1, 2), F.lit("00"), _bare(body)))
        off = F.pmod(_mod97(_bare(entity)) - 1, F.lit(97))
        check = F.pmod(right - 2 + off, F.lit(97)) + 2
        return F.concat(F.substring(entity, 1, 2), F.lpad(check.cast("string"), 2, "0"), body)

    return _once(F.substring(drawn, F.lit(5), F.length(drawn)), checked)


def _card(entity: Column, d: Column) -> Column:
    """A card keeps its first digit and, through its last one, whether its check sum is right."""

    def checked(drawn: Column) -> Column:
        due = ((10 - _luhn(F.concat(F.regexp_replace(F.substring(drawn, F.lit(1), F.length(drawn) - 1), r"\D", ""), F.lit("0")))) % 10).cast("int")
        valid = _luhn(F.regexp_replace(entity, r"\D", "")) == 0
        last = F.when(valid, due).otherwise((due + 1 + _byte(d, F.lit(99)) % 9) % 10).cast("string")
        return F.concat(F.substring(drawn, F.lit(1), F.length(drawn) - 1), last)

    return _once(F.concat(F.substring(entity, 1, 1), _chars(F.substring(entity, F.lit(2), F.length(entity)), d, False)), checked)


def _email(entity: Column, d: Column, attempt: Column, key: str) -> Column:
    """The domain has a digest of its own, so that all of its addresses stay together; its last label stays. Later attempts add letters."""
    at = F.instr(entity, "@")
    host = F.substring(entity, at + 1, F.length(entity))
    top = F.element_at(F.split(host, r"\."), -1)
    domain = _hex(key, F.lit("domain"), F.lower(host), F.lit(0))
    more = F.when(attempt >= LONGER, F.array_join(F.transform(F.sequence(F.lit(LONGER), attempt), lambda i: _letter(d, F.lit("a"), i + 90)), "")).otherwise("")
    return F.concat(_chars(F.substring(entity, F.lit(1), at - 1), d), more, F.lit("@"), _once(domain, lambda x: _chars(F.substring(host, F.lit(1), F.length(host) - F.length(top) - 1), x)), F.lit("."), top)


def _person(canon: Column, gender: Column, d: Column, attempt: Column) -> Column:
    """The last word becomes a family name, the others given names of the gender, all in the name's script."""
    words = F.split(canon, " ")
    script = F.when(canon.rlike(r"\p{IsCyrillic}"), "cyrillic").when(canon.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    lists = F.create_map(*[x for k, v in GIVEN.items() for x in (F.lit(k), _in(v))])
    own = F.element_at(lists, F.concat(script, F.lit("_"), gender))
    parts = F.element_at(F.create_map(*[x for k, v in SYLLABLES.items() for x in (F.lit(k), _in(v))]), script)
    length = F.lit(4) + F.floor(attempt / LONGER).cast("int")
    family = F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), length), lambda i: F.get(parts, _byte(d, i + 10) % F.size(parts))), ""))
    given = lambda i: F.get(own, _byte(d, i + 60) % F.size(own))
    return F.array_join(F.transform(words, lambda w, i: F.when(i == F.size(words) - 1, family).otherwise(given(i))), " ")


def surrogate(entity: Column, kind: Column, canon: Column, gender: Column, attempt: Column, key: str) -> Column:
    """What stands for a mention. A mention of a family name alone gets that of its person."""
    title = title_of(entity)

    def drawn(d: Column) -> Column:
        person = _person(canon, gender, d, attempt)
        own = F.when(canonical(entity, kind) == canon, person).otherwise(F.element_at(F.split(person, " "), -1))
        name = F.when(title == "", own).otherwise(F.concat(title, F.lit(" "), own))
        octet = lambda n: (_byte(d, F.lit(2 * n)) * 256 + _byte(d, F.lit(2 * n + 1))) % 254 + 1
        ip = F.concat_ws(".", *[octet(n).cast("string") for n in range(4)])
        country = F.regexp_extract(entity, r"^\+\d{1,3}(?=[ .(-])", 0)
        phone = F.concat(country, _chars(F.substring(entity, F.length(country) + 1, F.length(entity)), d, False))
        return (
            F.when(kind == "email", _email(entity, d, attempt, key)).when(kind == "ip", ip).when(kind == "phone", phone)
            .when(kind == "card", _card(entity, d)).when(kind == "iban", _iban(entity, d)).when(kind == "name", name).otherwise(_chars(entity, d, False))
        )

    return _once(_hex(key, kind, canon, attempt), drawn)


def with_mentions(docs: DataFrame) -> DataFrame:
    """Add ``_lx_pattern`` and ``_lx_found``, the mentions (entity, kind, canon, gender) in order.

    Names that were found by a title are looked for once more, without it. Of a family
    name alone, the first person of the text who bears it is meant.
    """
    t = F.col("text")
    has = t.isNotNull() & (F.contains(t, F.lit("@")) | t.rlike(_DIGITS) | (t.rlike(_MAYBE_TITLE) & t.rlike(_TITLED)))
    none = F.array().cast("array<string>")
    first = docs.withColumn("_lx_first", F.when(has, F.regexp_extract_all(F.col("text"), F.lit(PATTERN), F.lit(0))).otherwise(none))
    titled = F.filter("_lx_first", lambda e: title_of(e) != "")
    people = F.when(F.size("_lx_first") > 0, F.array_distinct(F.transform(titled, lambda e: canonical(e, F.lit("name"))))).otherwise(none)
    known = first.withColumn("_lx_people", people)
    families = F.filter(F.transform("_lx_people", lambda p: F.element_at(F.split(p, " "), -1)), lambda w: F.length(w) > 2)
    spellings = F.reverse(F.array_sort(F.transform(F.array_distinct(F.concat("_lx_people", families)), lambda p: F.struct(F.length(p).alias("n"), p.alias("p")))))
    again = F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{M}'’-])(?:\Q"), F.array_join(F.transform(spellings, lambda x: x["p"]), r"\E|\Q"), F.lit(r"\E)(?![\p{L}\p{M}]|['’-]\p{L}{2})"))
    known = known.withColumn("_lx_pattern", F.when(F.size("_lx_people") > 0, again).otherwise(F.lit(PATTERN)))
    known = known.withColumn("_lx_all", F.when(F.size("_lx_people") > 0, F.regexp_extract_all(F.col("text"), F.col("_lx_pattern"), F.lit(0))).otherwise(F.col("_lx_first")))

    def person(bare: Column) -> Column:
        bearer = F.get(F.filter("_lx_people", lambda p: p.endswith(F.concat(F.lit(" "), bare))), F.lit(0))
        return F.when(F.contains(bare, F.lit(" ")), bare).otherwise(F.coalesce(bearer, bare))

    def mention(e: Column) -> Column:
        return _once(kind_of(e), lambda k: F.struct(e.alias("entity"), k.alias("kind"), F.when(k == "name", person(canonical(e, k))).otherwise(canonical(e, k)).alias("canon"), F.when(k == "name", gender_of(e)).otherwise("n").alias("gender")))

    found = F.when(F.size("_lx_all") > 0, F.transform("_lx_all", mention)).otherwise(F.array().cast(_PERSON))
    return known.withColumn("_lx_found", found).drop("_lx_first", "_lx_people", "_lx_all")


def settle(mentions: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt, gender) of entities that differ from the first draw of one of their mentions.

    ``mentions`` are (entity, kind, canon, gender). Each round keeps, of the entities
    that draw one surrogate, the first; the others draw again. A surrogate that an
    entity of the corpus bears is no one's. Surrogates are compared in canonical form,
    which is the same for all spellings of an entity.
    """
    spark = mentions.sparkSession
    f, m, n = (F.max((F.col("gender") == g).cast("int")) for g in "fmn")
    grouped = mentions.groupBy("kind", "canon").agg(F.min("entity").alias("entity"), f.alias("f"), m.alias("m"), n.alias("n"))
    gender = F.when((F.col("f") == 1) & (F.col("m") == 0), "f").when((F.col("m") == 1) & (F.col("f") == 0), "m").otherwise("n")
    whole = F.when(F.col("kind") == "name", F.col("canon")).otherwise(F.col("entity"))
    # a given number of tasks: the rows are few bytes, but each of them is much work
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    forms = cut(grouped.select("kind", "canon", whole.alias("entity"), gender.alias("gender"), (F.col("f") + F.col("m") + F.col("n") > 1).alias("mixed")).repartition(tasks, "kind", "canon"), "entities")
    open_ = forms.withColumn("attempt", F.lit(0))
    taken, settled = forms.select("kind", F.col("canon").alias("drawn")), forms.filter("mixed").select("kind", "canon", F.lit(0).alias("attempt"), "gender")
    for _ in range(MAX_ATTEMPTS):
        one = surrogate(F.col("entity"), F.col("kind"), F.col("canon"), F.col("gender"), F.col("attempt"), key)
        tried = cut(open_.repartition(tasks, "kind", "canon").withColumn("drawn", canonical(one, F.col("kind"))), "drawn")
        first = tried.join(taken, ["kind", "drawn"], "left_anti").groupBy("kind", "drawn").agg(F.min("canon").alias("canon"))
        won = cut(first, "won")
        settled = settled.union(tried.filter("attempt > 0").join(won, ["kind", "drawn", "canon"], "left_semi").select("kind", "canon", "attempt", "gender"))
        open_ = cut(tried.join(won, ["kind", "drawn", "canon"], "left_anti").select("kind", "canon", "entity", "gender", "mixed", (F.col("attempt") + 1).alias("attempt")), "open")
        if open_.isEmpty():
            return settled.groupBy("kind", "canon").agg(F.max("attempt").alias("attempt"), F.first("gender").alias("gender"))
        taken = taken.union(won.select("kind", "drawn"))
    raise RuntimeError(f"surrogates still collide after {MAX_ATTEMPTS} draws")


def replace_entities(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(doc_id, text, n_entities, kinds) with surrogates for every row of ``docs`` (doc_id, text).

    A null text stays null; a text without entities stays as it is; rows that repeat an
    id, and rows without one, are rows of their own; extra columns are ignored; an empty
    table gives an empty result.
    """
    docs = with_mentions(docs.select("doc_id", "text"))
    mentions = cut(docs.filter(F.size("_lx_found") > 0).select("doc_id", F.inline("_lx_found")).distinct(), "mentions")
    settled = cut(settle(mentions, key), "settled")
    if settled.isEmpty():
        docs = docs.withColumn("tries", F.lit(None).cast("map<string,struct<attempt:int,gender:string>>"))
    else:
        # rows of one document only; AQE splits an entity that very many documents mention
        own = mentions.select("doc_id", "kind", "canon").distinct().join(settled, ["kind", "canon"])
        entry = F.struct(F.concat_ws(":", "kind", "canon").alias("key"), F.struct("attempt", "gender").alias("value"))
        by_doc = cut(own.groupBy(F.col("doc_id").alias("_lx_id")).agg(F.map_from_entries(F.collect_set(entry)).alias("tries")), "tries")
        small = by_doc.limit(20_001).count() <= 20_000
        docs = docs.join(F.broadcast(by_doc) if small else by_doc, F.col("doc_id").eqNullSafe(F.col("_lx_id")), "left")

    def drawn(x: Column) -> Column:
        return _once(F.element_at("tries", F.concat_ws(":", x["kind"], x["canon"])), lambda t: surrogate(x["entity"], x["kind"], x["canon"], F.coalesce(t["gender"], x["gender"]), F.coalesce(t["attempt"], F.lit(0)), key))

    parts = F.split(F.col("text"), F.col("_lx_pattern"), -1)
    text = F.array_join(F.zip_with(parts, F.concat(F.transform("_lx_found", drawn), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("_lx_found", lambda x: x["kind"]))), ",")
    return docs.select("doc_id", F.when(F.size("_lx_found") > 0, text).otherwise(F.col("text")).alias("text"), F.size("_lx_found").alias("n_entities"), kinds.alias("kinds"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents"))
