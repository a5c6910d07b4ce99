"""Operator 10, PII: surrogate generation, with DataFrame functions only.

Detected entities (mail addresses, phone and social-security numbers, IPv4 addresses, payment cards that pass
the Luhn check, names after a title) get keyed replacements of their own type: digits for digits and letters
for letters at the same places, the separators and the letter case of the mention, a valid check digit for
cards, the same domain for the same domain, names of the title's gender in the script of the original.

A name has any number of parts: initials, hyphens, apostrophes, inner capitals, capitals throughout, particles
between them (which stay).  Each part but an initial is an entity, one whatever its title and place; its gender
is that of its titles in the corpus, if they agree.  Capitalised words of a document that has such a name get
the same surrogate where they are one of its parts, title or not.  Initials become other letters.

The distinct entities form a table; a keyed hash proposes a surrogate for each.  A proposal that is another
entity's surrogate, or an entity of the corpus itself, is drawn again until no two entities share one, so
distinct entities stay distinct, and one entity has one surrogate in all documents and spellings.  Domains are
entities of their own, settled before the addresses in them.  Names are drawn from the listed ones first, then put
together from stems and gendered endings; names and addresses grow with the attempts, so their space never runs out.
Numbers keep their length: where ``ROUNDS`` rounds do not settle them (nearly all numbers of a length taken) the
operator raises an error.

Edge cases: a null text stays null; an empty text stays empty; repeated rows are rewritten alike; a long text
is rewritten whole; an empty table gives no rows; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, staged

KEY = "surrogate-key"  # default key; pass another one in production

# fixed values: titles by gender, replacement names by script and gender
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Госпожа", "Κυρία"],
    "n": ["Dr", "Prof"],
}
NAMES = {
    "latin": {"m": "james robert thomas daniel martin oliver simon peter lucas victor hugo felix",
              "f": "mary emma laura alice clara julia sophie nina elena marta irene paula",
              "n": "alex robin kim sasha jules andrea charlie morgan taylor jordan noel dana",
              "family": "walker turner fischer weber moreau lambert garcia romero hansen novak silva costa"},
    "cyrillic": {"m": "иван пётр сергей андрей павел", "f": "анна мария ольга елена ирина",
                 "n": "саша женя валя", "family": "иваненко петренко шевчук бондарь мороз"},
    "greek": {"m": "νίκος γιώργος πέτρος", "f": "μαρία ελένη άννα", "n": "άρης χάρις",
              "family": "δήμου λάμπρου ράπτη"},
}
# fixed values: what further names are put together from: stems, middles, endings by role
STEMS = {
    "latin": {"stem": "al ber cas dan el fer gar hal jor kel lan mar nor or per ral sam tor val wil",
              "middle": "ba da di fa ga ka la li ma mi na ni ra ri sa ta ti va ve zo",
              "m": "n s r l x rd ck ld st us", "f": "na ne lle tte ra la ssa nia ria ya", "n": "y i o u",
              "family": "son mann berg ley ton field sen ski wood er"},
    "cyrillic": {"stem": "ал бор вас гер дан ег кир лев мар ник ол пав род сав тим фёд яр",
                 "middle": "ба да ли ма ни ра ро са та ви", "m": "н й м р т к", "f": "на ла ра ся ия ва", "n": "е о у",
                 "family": "нко чук лаш бец дюк рга"},
    "greek": {"stem": "αλ βασ γερ δημ ευ θεο κων λεω μαν νικ παν σπυ", "middle": "ολ αν ιδ ερ ατ ον ικ αρ",
              "m": "ος ης ας", "f": "α η ω", "n": "ι υ", "family": "ίδης άκης όπουλος άτος"},
}
ROUNDS = 64  # of redrawing what clashes
ROWS = 2000  # entities of one task, each costing a millisecond
LETTERS = {"latin": ("aeiou", "bcdfghklmnprstvw"), "cyrillic": ("аеиоу", "бвгдзклмнпрст"), "greek": ("αειου", "βγδζκλμνπρστ")}

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
TITLE = "|".join(t for ts in TITLES.values() for t in sorted(ts, key=len, reverse=True))
PARTICLE = r"(?:(?:van|von|der|den|de|la|le|du|di|da|del|della|dos|ten|ter|zu|bin|ibn|al|el) |d['’])*"
# a capitalised word, an initial too; an apostrophe is inside if no ending such as 's follows
WORD = (r"(?<![\p{L}\p{N}_])\p{Lu}(?:[\p{L}\p{M}]|['’](?!(?:[sS]|ll|d|ve|re|m|t)(?!\p{L}))(?=\p{L}))*+(?![\p{N}_])")
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)"
             r"|(?<![\d+])\+\d{1,3}[ .-]?(?:\(0\) ?)?\(?\d{1,5}\)?(?:[ .-]\d{2,5}){2,4}(?!\d)"
             r"|(?<![\d+])\+\d{1,3}[ .-]\d{5}[ .-]?\d{5}(?!\d)|(?<![\d+])\+\d{8,15}(?!\d)"
             r"|(?<!\d)(?:(?<![\d.+-])1[ .-])?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)"
             r"|(?<![\d.+-])(?:1[ .-])?\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])|(?<![\d.+-])1 \d{3} \d{3} \d{4}(?!\d)"
             r"|(?<![\d.+-])[2-9]\d\d [2-9]\d\d[ -]\d{4}(?! ?\d)|(?<![\d.+-])0\d(?:[ .-]\d{2}){4}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "card": r"(?<![\d.])(?:\d{13,19}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4} \d{4} \d{4} \d{4})(?!\d)",
    "person": rf"(?<!\p{{L}})(?:(?:{TITLE})\.? )+{PARTICLE}{WORD}(?:(?: {PARTICLE}|-|(?<=(?<![\p{{L}}\p{{N}}_'’])\p{{Lu}})\. ?){WORD})*",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
WIDE = f"{ANY}|{WORD}"  # for texts that have a name after a title


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second from the right doubled (nines cast out)."""
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def kind_of(mention: Column) -> Column:
    """The type of a mention (word: a capitalised one without a title); null for a number that fails the card
    check."""
    full = lambda k: mention.rlike(f"^(?:{PATTERNS[k]})$")
    card = F.when(luhn_sum(_digits(mention)) % 10 == 0, F.lit("card"))
    return (F.when(mention.contains("@"), "email").when(mention.rlike(r"^\p{L}"), F.when(mention.contains(" "), "person").otherwise("word"))
            .when(full("ip"), "ip")
            .when(full("ssn"), "ssn").when(full("phone"), "phone").otherwise(card))


def _script(c: Column) -> Column:
    return F.when(c.rlike(r"\p{IsCyrillic}"), "cyrillic").when(c.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _space(kind: Column) -> Column:
    """Within what surrogates are distinct: the kind, for names the script."""
    return F.when(kind.contains(":"), F.concat(F.lit("name:"), F.substring_index(kind, ":", -1))).otherwise(kind)


def parts_of(mention: Column) -> Column:
    """The parts of a mention: kind (null: literal text), role of a name (the title's gender for given names,
    family, or word: a name only if the document has it after a title), canonical value, text as written."""
    def part(kind: Column, value: Column, raw: Column, role: Column | None = None) -> Column:
        role = F.lit(None) if role is None else role
        return F.struct(kind.cast("string").alias("kind"), role.cast("string").alias("role"), value.alias("value"), raw.alias("raw"))

    def name(token: Column, role: Column) -> Column:
        initial = F.length(token) == 1
        return part(F.concat(F.when(initial, "initial:").otherwise("name:"), _script(token)),
                    F.lower(F.regexp_replace(token, "’", "'")), token, F.when(~initial, role))

    kind = kind_of(mention)
    title = F.regexp_extract(mention, rf"^(?:(?:{TITLE})\.? )+", 0)
    gender = F.lit("n")
    for g in ("m", "f"):
        gender = F.when(title.rlike(rf"(?<!\p{{L}})(?:{'|'.join(TITLES[g])})(?!\p{{L}})"), g).otherwise(gender)
    rest = F.substr(mention, F.length(title) + 1)
    words, gaps = F.regexp_extract_all(rest, F.lit(WORD), F.lit(0)), F.split(rest, WORD, -1)
    literal = lambda c: part(F.lit(None), F.lit(None).cast("string"), c)
    # the family name is what no blank or point follows: the last part, with hyphens the last ones
    given = lambda i: F.exists(F.slice(gaps, i + 2, F.size(words) - 1 - i), lambda c: c.rlike("[ .]"))
    person = F.concat(F.array(literal(F.concat(title, gaps[0]))), F.flatten(F.transform(words, lambda w, i: F.array(
        name(w, F.when(given(i), gender).otherwise("family")), literal(F.element_at(gaps, i + 2))))))
    value = F.when(kind == "email", F.lower(mention)).when(kind == "ip", mention).otherwise(_digits(mention))
    return (F.when(kind.isNull(), F.array(literal(mention))).when(kind == "person", person)
            .when(kind == "word", F.array(F.when(F.length(mention) > 1, name(mention, F.lit("word"))).otherwise(literal(mention)))).otherwise(F.array(part(kind, value, mention))))


def _stream(key: str, *cols: Column) -> Column:
    """128 hexadecimal digits that depend on the key and the columns."""
    tag = F.concat_ws("\u0001", F.lit(key), *cols)
    return F.concat(F.sha2(F.concat(tag, F.lit("\u00010")), 256), F.sha2(F.concat(tag, F.lit("\u00011")), 256))


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substr(stream, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _each(value: Column, change) -> Column:
    """Rebuild a string from ``change(character, place from 0)``."""
    places = F.sequence(F.lit(0), F.length(value) - 1)
    return F.when(F.length(value) == 0, "").otherwise(
        F.array_join(F.transform(places, lambda i: change(F.substr(value, i + 1, F.lit(1)), i)), ""))


def _shifted(stream: Column):
    """Digits to digits, small letters to small letters, never to themselves; the rest stays."""
    alphabet = F.lit("abcdefghijklmnopqrstuvwxyz")

    def change(c: Column, i: Column) -> Column:
        b = _byte(stream, i)
        return (F.when(c.rlike("[0-9]"), ((F.ascii(c) - 48 + 1 + b % 9) % 10).cast("string"))
                .when(c.rlike("[a-z]"), F.substr(alphabet, (F.ascii(c) - 97 + 1 + b % 25) % 26 + 1, F.lit(1))).otherwise(c))
    return change


def _grown(stream: Column, letters: Column) -> Column:
    """So many further letters."""
    alphabet = F.lit("abcdefghijklmnopqrstuvwxyz")
    some = F.transform(F.sequence(F.lit(1), letters), lambda i: F.substr(alphabet, _byte(stream, F.lit(64) - i) % 26 + 1, F.lit(1)))
    return F.when(letters > 0, F.array_join(some, "")).otherwise("")


def surrogate(kind: Column, value: Column, attempt: Column, stream: Column, domain: Column) -> Column:
    """The canonical surrogate of an entity at this attempt, drawn from its ``stream``; ``domain`` is that of a mail
    address's surrogate."""
    first = F.substr(value, F.lit(1), F.lit(1))
    number = F.concat(first, _each(F.substr(value, F.lit(2)), _shifted(stream)))
    body = F.substr(number, F.lit(1), F.length(number) - 1)
    check = ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    longer = F.greatest(attempt - 8, F.lit(0))
    email = F.concat(_each(F.substring_index(value, "@", 1), _shifted(stream)), _grown(stream, longer), F.lit("@"), domain)
    top = F.regexp_extract(value, r"\.[^.]+$", 0)
    host = F.substr(value, F.lit(1), F.length(value) - F.length(top))
    site = F.concat(_each(host, _shifted(stream)), _grown(stream, F.when(host.rlike("[a-z0-9]"), longer).otherwise(attempt + 1)), top)
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_byte(stream, i) % 254 + 1).cast("string")), ".")
    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", F.concat(body, check)).when(kind == "phone", number)
    out = out.when(kind == "ssn", _each(value, _shifted(stream))).when(kind == "domain", site)

    def drawn(words: str, i: Column) -> Column:
        return F.element_at(F.split(F.lit(words), " "), _byte(stream, i) % len(words.split()) + 1)

    def several(words: str) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), 1 + F.floor(attempt / 3).cast("int")), lambda i: drawn(words, i)), "")

    for script, lists in NAMES.items():
        made = STEMS[script]
        middles = several(made["middle"])
        for role, names in lists.items():
            built = F.concat(drawn(made["stem"], F.lit(0)), middles, drawn(made[role], F.lit(63)))
            out = out.when(kind == f"{role}:{script}", F.when(attempt == 0, drawn(names, F.lit(0))).otherwise(built))
    return out


def _initial(kind: Column, value: Column, key: str) -> Column:
    """Another letter of the script; letters are too few for a letter of its own each."""
    b, out = _byte(_stream(key, kind, value), F.lit(0)), F.lit(None).cast("string")
    for script, (vowels, others) in LETTERS.items():
        letters = F.lit(vowels + others)
        n = len(vowels + others)
        out = F.when(kind.endswith(script), F.substr(letters, (F.instr(letters, value) + b % (n - 1)) % n + 1, F.lit(1))).otherwise(out)
    return out


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``kind``, ``value``, ``surrogate``: one to one within each kind (names: script), no surrogate an entity itself."""
    mail = F.col("kind") == "email"
    site = F.substring_index("value", "@", -1)
    sites = _settled(entities.filter(mail).select(F.lit("domain").alias("kind"), site.alias("value")).distinct().withColumn("domain", F.lit("")), key)
    sites = sites.select(F.col("value").alias("site"), F.col("surrogate").alias("domain"))
    own = entities.select("kind", "value")
    known = own.filter(mail).join(sites, site == F.col("site")).select("kind", "value", "domain")
    return _settled(own.filter(~mail).withColumn("domain", F.lit("")).unionByName(known), key)


def _settled(entities: DataFrame, key: str) -> DataFrame:
    """Draw surrogates round by round.  What is drawn is judged against the entities, the settled surrogates and the round's
    other proposals; only what clashes is drawn again.  The number of clashes alone reaches the driver."""
    own = staged(entities.withColumn("space", _space(F.col("kind"))), "pii-entities")
    real = own.select("space", F.col("value").alias("surrogate"), F.lit(True).alias("taken"))
    left, n, settled = own, own.count(), []
    for attempt in range(ROUNDS):
        tries = left.repartition(min(max(1, n // ROWS), 20000)) if n > ROWS else left
        tries = tries.withColumn("stream", _stream(key, F.col("kind"), F.col("value"), F.lit(str(attempt))))
        drawn = tries.select("space", "kind", "value", "domain", surrogate(F.col("kind"), F.col("value"), F.lit(attempt), F.col("stream"), F.col("domain")).alias("surrogate"))
        drawn = staged(drawn, "pii-drawn")
        owner = drawn.groupBy("space", "surrogate").agg(F.min("value").alias("owner"))
        taken = real
        for before in settled:
            taken = taken.unionByName(before.select("space", "surrogate", F.lit(True).alias("taken")))
        judged = drawn.join(owner, ["space", "surrogate"]).join(taken.distinct(), ["space", "surrogate"], "left").withColumn(
            "clash", F.col("taken").isNotNull() | (F.col("owner") != F.col("value")))
        judged = staged(judged.select("space", "kind", "value", "domain", "surrogate", "clash"), "pii-judged")
        settled.append(judged.filter(~F.col("clash")))
        left = judged.filter("clash").select("space", "kind", "value", "domain")
        n = left.count()
        if not n:
            return reduce(DataFrame.unionByName, settled).select("kind", "value", "surrogate")
    raise RuntimeError(f"{n} entities have no free surrogate of their format after {ROUNDS} rounds")


def _written(kind: Column, raw: Column, new: Column) -> Column:
    """The surrogate in the mention's format: its separators for numbers, its letter case for the rest."""
    def number(c: Column, i: Column) -> Column:
        nth = F.length(_digits(F.substr(raw, F.lit(1), i + 1)))
        return F.when(c.rlike("[0-9]"), F.substr(new, nth, F.lit(1))).otherwise(c)

    def case(c: Column, i: Column) -> Column:
        own = F.substr(raw, i + 1, F.lit(1))
        return F.when(own != F.lower(own), F.upper(c)).otherwise(c)
    name = F.when((F.length(raw) > 1) & (raw == F.upper(raw)), F.upper(new)).otherwise(F.initcap(new))
    return (F.when(kind.isNull(), raw).when(kind.isin("phone", "ssn", "card"), _each(raw, number))
            .when(kind == "ip", new).when(kind == "email", _each(new, case)).otherwise(name))


def replace_pii(df: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """All columns of ``df`` with the entities of ``text_col`` replaced, and ``found``: an array of the kinds
    of the replaced parts, in order."""
    names = df.columns
    row, hits, found, new = (free(df, n) for n in ("row", "hits", "found", "new_text"))
    marked = staged(df.withColumn(row, F.monotonically_increasing_id())
                    .withColumn(hits, F.regexp_extract_all(F.col(text_col), F.lit(ANY), F.lit(0))), "pii-docs")
    keep = [F.col(f"`{c}`") for c in names]
    dirty = F.coalesce(F.size(hits), F.lit(0)) > 0
    clean = marked.filter(~dirty).select(*keep, F.array().cast("array<string>").alias(found))
    named = F.exists(F.col(hits), lambda h: h.rlike(r"^\p{L}") & h.contains(" "))
    wide = F.when(named, F.regexp_extract_all(F.col(text_col), F.lit(WIDE), F.lit(0))).otherwise(F.col(hits))
    hit = (marked.filter(dirty).select(F.col(row).alias("row"), F.posexplode(wide).alias("at", "mention"))
           .select("row", "at", F.posexplode(parts_of(F.col("mention"))).alias("part", "p"))
           .select("row", "at", "part", "p.kind", "p.role", "p.value", "p.raw").filter("raw != ''"))
    hit = staged(hit, "pii-mentions")
    word, entity = F.col("role").eqNullSafe("word"), F.col("kind").isNotNull() & ~F.coalesce(F.col("kind").startswith("initial"), F.lit(False))
    own = hit.filter("role != 'word'").select("row", "kind", "value").distinct().withColumn("own", F.lit(True))
    words = hit.filter(word).join(own, ["row", "kind", "value"], "left").withColumn("kind", F.when(F.col("own"), F.col("kind"))).drop("own")
    hit = hit.filter(~word).unionByName(words)
    roles = hit.filter(entity).groupBy("kind", "value").agg(*[F.coalesce(F.max(F.col("role") == g), F.lit(False)).alias(g) for g in "mfn"])
    gender = F.when(F.col("m") & ~F.col("f"), "m").when(F.col("f") & ~F.col("m"), "f").when(F.col("m") | F.col("n"), "n").otherwise("family")
    table = surrogates(roles.select(F.when(F.col("kind").startswith("name:"), F.concat(gender, F.substr("kind", F.lit(5)))).otherwise(F.col("kind")).alias("kind"), "value"), key)
    table = table.select(_space(F.col("kind")).alias("space"), "value", F.col("kind").alias("as"), "surrogate")
    piece = lambda kind, new: F.struct((F.col("at") * 2 + 1).alias("at"), "part", _written(kind, F.col("raw"), new).alias("s"), kind.alias("kind")).alias("piece")
    done = (hit.filter(entity).withColumnRenamed("kind", "space").join(table, ["space", "value"])
            .select("row", piece(F.col("as"), F.col("surrogate")))
            .unionByName(hit.filter(~entity).select("row", piece(F.col("kind"), _initial(F.col("kind"), F.col("value"), key)))))
    done = done.groupBy("row").agg(F.collect_list("piece").alias("pieces"))
    split = F.when(named, F.split(F.col(text_col), WIDE, -1)).otherwise(F.split(F.col(text_col), ANY, -1))
    between = F.transform(split, lambda s, i: F.struct(
        (i * 2).alias("at"), F.lit(0).alias("part"), s.alias("s"), F.lit(None).cast("string").alias("kind")))
    pieces = F.array_sort(F.concat(between, "pieces"), lambda a, b: F.when(a["at"] != b["at"], a["at"] - b["at"]).otherwise(a["part"] - b["part"]))
    fixed = (marked.filter(dirty).join(done.withColumnRenamed("row", row), row).withColumn(new, pieces)
             .select(*[F.array_join(F.transform(new, lambda p: p["s"]), "").alias(c) if c == text_col else F.col(f"`{c}`") for c in names],
                     F.filter(F.transform(new, lambda p: p["kind"]), lambda k: k.isNotNull()).alias(found)))
    return clean.unionByName(fixed)


def op10(docs: DataFrame) -> DataFrame:
    out = replace_pii(docs.select("doc_id", "text"))
    of_kind = lambda kind: F.size(F.array_remove(F.transform("found", lambda k: k == kind), F.lit(False))).cast("long")
    counts = [of_kind(kind).alias(f"n_{kind}") for kind in ("email", "phone", "ssn", "ip", "card")]
    names = F.size(F.filter("found", lambda k: k.contains(":"))).cast("long").alias("n_name_parts")
    return out.select("doc_id", "text", *counts, names)


def stage(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the documents with surrogates in their texts."""
    return replace_pii(docs).select(*[F.col(f"`{c}`") for c in docs.columns])
