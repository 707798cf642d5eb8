"""Surrogates for personal data, by DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import grouped, row_key, texts, written

# fixed values: titles by gender, given names by gender and script
TITLES = {"m": ["Mr", "Sir", "Herr", "Señor", "Sr", "Monsieur", "Господин"], "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа"], "u": ["Dr", "Prof", "Mx"]}
GIVEN = {
    "m": ["James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Charles", "Daniel", "Matthew", "Andrew", "Peter", "Paul", "Carlos", "José", "Luis", "Miguel", "Pierre", "Jacques", "François", "Jean", "Hans", "Klaus", "Jürgen", "Stefan", "Иван", "Сергей", "Алексей", "Дмитрий", "Γιώργος", "Νίκος"],
    "f": ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Nancy", "Emma", "Olivia", "Alice", "María", "Carmen", "Lucía", "Isabel", "Marie", "Claire", "Sophie", "Amélie", "Anna", "Ingrid", "Ursula", "Greta", "Анна", "Мария", "Ольга", "Наталья", "Ελένη", "Σοφία"],
}

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_NAME = r"\p{Lu}[\p{Ll}\p{M}]+(?:[-'’]\p{Lu}?[\p{Ll}\p{M}]+)?"
# fixed values: small words inside names, what names stand before and what they stand behind
PARTICLES = "van|von|der|den|de|del|della|da|dos|di|la|le|bin|ibn|al|el|ter|zu"
ACTS = "met|said|says|wrote|writes|told|asked|replied|answered|called|lives|lived|works|worked|joined|emailed|phoned|signed|explained|added"
CUES = "met|told|asked|called|contact|Contact|Dear|Hello|Hi|Name:|name:|Author:|author:|From:|To:|Cc:|Attn:|Signed,|Regards,|Sincerely,"
_TITLE = "|".join(t for g in TITLES.values() for t in g)
_FIRST = "|".join(n for g in GIVEN.values() for n in g)
#: Initials and small words between the first and last word of a name.
_INNER = rf"(?: (?:\p{{Lu}}\.|(?:{PARTICLES})(?!\p{{L}})))*+"
#: One pattern for each kind, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.(?=\p{L}{2}|[\p{L}\p{N}-]++\.))++\p{L}{2,}+",
    "ip": rf"(?<![\p{{L}}\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}]|\.[0-9])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}+])\+(?=(?:[ .()-]{0,2}[0-9]){8,15}(?![0-9]))[0-9]{1,3}[ .-]?\(?[0-9]{1,14}\)?(?:[ .-]?[0-9]{2,8}){0,4}(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}])(?:[0-9]{4}[ -]){3}[0-9]{4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])[0-9]{13,19}(?![\p{L}\p{N}])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:(?:{_TITLE})\.? {_NAME}(?:{_INNER} {_NAME})?|(?:{_FIRST}){_INNER} {_NAME}|{_NAME}{_INNER} {_NAME}(?= (?:{ACTS})(?!\p{{L}}))|(?<=(?<!\p{{L}})(?:{CUES}) ){_NAME}{_INNER} {_NAME})(?![\p{{L}}\p{{N}}])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without one of these has no entity: a cheap test before the patterns.
HINT = rf"[@0-9]|(?<![\p{{L}}])(?:{_TITLE}|{_FIRST})[ .]|(?<![\p{{L}}])(?:{CUES}) \p{{Lu}}|\p{{Ll}} (?:{ACTS})(?!\p{{L}})"

# fixed values: what a letter of each script is replaced from, sixteen for the sixteen hexadecimal digits
LETTERS = {"latin": "abdefghiklmnorst", "cyrillic": "абвгдезиклмнорст", "greek": "αβγδεζηικλμνοπρσ"}
# fixed values: syllables that made-up names are put together from, sixteen of each script
SYLLABLES = {
    "latin": ["ba", "ce", "di", "fo", "gu", "ha", "ke", "li", "mo", "nu", "pa", "re", "si", "to", "vu", "ze"],
    "cyrillic": ["ба", "ве", "ги", "до", "жу", "за", "ке", "ли", "мо", "ну", "па", "ре", "си", "то", "фу", "че"],
    "greek": ["βα", "γε", "δι", "ζο", "θυ", "κα", "λε", "μι", "νο", "ξυ", "πα", "ρε", "σι", "το", "φυ", "χε"],
}
# fixed values: endings of made-up names by script and role
ENDINGS = {
    "latin": {"given_m": "rn", "given_f": "na", "given_u": "l", "surname": "ck", "surname_a": "ck"},
    "cyrillic": {"given_m": "р", "given_f": "на", "given_u": "ль", "surname": "ов", "surname_a": "ова"},
    "greek": {"given_m": "ος", "given_f": "να", "given_u": "ις", "surname": "ης", "surname_a": "ου"},
}

# fixed values: the country calling codes of one digit, then those of two; all others have three
CALLING = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98|[0-9]{3}"

#: So many further attempts keep the length of an email's local part, each one after them adds a letter.
SAME_LENGTH = 3


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def script_of(c: Column) -> Column:
    return F.when(c.rlike(r"\p{IsCyrillic}"), "cyrillic").when(c.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def kind_of(c: Column) -> Column:
    """Which pattern a detected entity is of."""
    whole = [F.when(c.rlike(f"^(?:{p})$"), k) for k, p in PATTERNS.items()]
    return F.coalesce(*whole, F.lit("name"))


def canonical(kind: Column, c: Column) -> Column:
    """What mentions of one entity have in common: case and separators don't count, nor the country code 1 of a phone number.

    A number with another country code is written +code national, others are digits alone.
    """
    d = _digits(c)
    code = F.regexp_extract(d, f"^(?:{CALLING})", 0)
    abroad = F.concat(F.lit("+"), code, F.lit(" "), F.substr(d, F.length(code) + 1))
    home = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    phone = F.when(c.startswith("+") & (code != "1") & (F.length(code) < F.length(d)), abroad).otherwise(home)
    return F.when(kind == "phone", phone).when(kind.isin("card", "ssn"), d).otherwise(F.lower(c))


def _hash(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *[p.cast("string") for p in parts]), 256)


def _at(stream: Column, i: Column) -> Column:
    return F.substr(stream, i % 64 + 1, F.lit(1))


def _by_digit(mention: Column, stream: Column, skip: Column) -> Column:
    """A number with its digits beyond the first `skip` taken from a stream of hexadecimal digits, whatever stands between them."""
    digits = F.translate(stream, "abcdef", "012345")

    def put(c: Column, i: Column) -> Column:
        before = F.length(_digits(F.substr(mention, F.lit(1), i)))
        return F.when(c.rlike("[0-9]") & (before >= skip), _at(digits, before - skip)).otherwise(c)

    return F.array_join(F.transform(F.split(mention, ""), put), "")


def _by_place(part: Column, digits: Column, letters: Column) -> Column:
    """Part of an address with the digits and letters of streams, each from its place; other signs stay."""
    low = lambda i: _at(letters, i)
    put = lambda c, i: F.when(c.rlike("[0-9]"), _at(digits, i)).when(c.rlike(r"\p{Lu}"), F.upper(low(i))).when(c.rlike(r"\p{L}"), low(i)).otherwise(c)
    return F.array_join(F.transform(F.split(part, ""), put), "")


def _letters(stream: Column, script: Column) -> Column:
    table = [F.when(script == s, F.translate(stream, "0123456789abcdef", x)) for s, x in LETTERS.items()]
    return F.coalesce(*table)


def _luhn(digits: Column) -> Column:
    """The sum whose multiples of ten are valid card numbers."""
    back = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(back, F.lit(0), lambda a, x: a + x)


def _card(mention: Column, stream: Column) -> Column:
    """Digits anew; a number with a valid check digit gets one."""
    new = _by_digit(mention, stream, F.lit(0))
    zero = F.regexp_replace(new, "[0-9]$", "0")
    check = F.pmod(F.lit(10) - F.pmod(_luhn(_digits(zero)), F.lit(10)), F.lit(10)).cast("string")
    return F.when(F.pmod(_luhn(_digits(mention)), F.lit(10)) == 0, F.concat(F.regexp_replace(new, "[0-9]$", ""), check)).otherwise(new)


def _made_up(kind: Column, value: Column, stream: Column, attempt: Column) -> Column:
    """A name of the same script and gender from syllables, in the case of the mention; more attempts, more syllables."""
    script = script_of(value)
    syllable = lambda i: F.coalesce(*[F.when(script == s, F.element_at(F.array(*map(F.lit, x)), F.conv(F.substr(stream, i, F.lit(1)), 16, 10).cast("int") + 1)) for s, x in SYLLABLES.items()])
    stem = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3) + attempt), syllable), "")
    role = F.when((kind == "surname") & value.rlike("[ая]$"), "surname_a").otherwise(kind)
    end = F.coalesce(*[F.when((script == s) & (role == r), e) for s, x in ENDINGS.items() for r, e in x.items()])
    name = F.concat(stem, end)
    return F.when(value == F.upper(value), F.upper(name)).when(value.rlike(r"^\p{Lu}"), F.initcap(name)).otherwise(name)


def with_surrogate(entities: DataFrame, key: str, mention: str) -> DataFrame:
    """entities (kind, canon, attempt, other ...) and `new`: the replacement of a mention, a keyed function of its canonical form, in the mention's format.

    `other` is the canonical form that it takes over instead, or null.

    The hash streams are columns of their own, so that they are worked out once and not for each character.
    """
    kind, canon, attempt, value = (F.col(c) for c in ("kind", "canon", "attempt", mention))
    swapped = F.col("other")
    mail, domain = kind == "email", F.substring_index(value, "@", -1)
    tail = F.regexp_extract(domain, r"\.\p{L}+$", 0)
    local, host = F.substring_index(value, "@", 1), F.substr(domain, F.lit(1), F.length(domain) - F.length(tail))
    rows = entities.withColumns({"own": _hash(key, kind, canon, attempt), "local": F.when(mail, local), "host": F.when(mail, host), "tail": F.when(mail, tail)})
    rows = rows.withColumns({"on_host": F.when(mail, _hash(key, F.lit("host"), F.lower("host"))), "further": F.when(mail, _hash(key, F.lit("more"), kind, canon, attempt))})
    own, on_host, local, host = (F.col(c) for c in ("own", "on_host", "local", "host"))
    streams = {"own_letters": _letters(own, script_of(local)), "more_letters": _letters(F.col("further"), script_of(local)), "host_letters": _letters(on_host, script_of(host))}
    digits = lambda c: F.translate(c, "abcdef", "012345")
    rows = rows.withColumns({**{c: F.when(mail, x) for c, x in streams.items()}, "own_digits": digits(own), "host_digits": F.when(mail, digits(on_host))})
    # an email that still collides gets a longer local part: short ones are few at one host
    more = F.substr(F.col("more_letters"), F.lit(1), F.greatest(attempt - SAME_LENGTH, F.lit(0)))
    more = F.when(local.rlike(r"\p{Lu}") & (local == F.upper(local)), F.upper(more)).otherwise(more)
    email = F.concat(_by_place(local, F.col("own_digits"), F.col("own_letters")), more, F.lit("@"), _by_place(host, F.col("host_digits"), F.col("host_letters")), F.col("tail"))
    octet = [(F.conv(F.substr(own, F.lit(1 + 8 * i), F.lit(7)), 16, 10).cast("long") % 254 + 1).cast("string") for i in range(4)]
    phone = _by_digit(value, own, F.length(_digits(value)) - F.length(F.substring_index(canon, " ", -1)))
    new = (
        F.when(swapped.isNotNull(), F.when(kind == "ip", swapped).otherwise(_by_digit(value, _digits(swapped), F.greatest(F.length(_digits(value)) - F.length(_digits(swapped)), F.lit(0)))))
        .when(mail, email).when(kind == "ip", F.concat_ws(".", *octet)).when(kind == "phone", phone).when(kind == "ssn", _by_digit(value, own, F.lit(0)))
        .when(kind == "card", _card(value, own)).when(kind == "as_is", value).otherwise(_made_up(kind, value, own, attempt))
    )
    return rows.select(*entities.columns, new.alias("new"))


def _parts(mention: Column) -> Column:
    """A mention as (kind, value) parts. A name's title and spaces stay; its words are a given name or a surname."""
    words = F.split(mention, " ")
    title = F.regexp_replace(F.element_at(words, 1), r"\.$", "")
    titled = title.isin([t for g in TITLES.values() for t in g])
    listed = lambda c: F.when(c.isin(GIVEN["f"]), "given_f").when(c.isin(GIVEN["m"]), "given_m")
    by_title = F.when(title.isin(TITLES["f"]), "given_f").when(title.isin(TITLES["m"]), "given_m").otherwise("given_u")

    def part(w: Column, i: Column) -> Column:
        first = F.when(titled, 1).otherwise(0)
        inner = w.rlike(rf"^(?:\p{{Lu}}\.|{PARTICLES})$")
        kind = F.when((titled & (i == 0)) | inner, "as_is").when((i == first) & (F.size(words) > first + 1), F.coalesce(listed(w), by_title)).otherwise("surname")
        return F.struct(kind.alias("kind"), w.alias("value"))

    kind = kind_of(mention)
    return F.when(kind == "name", F.transform(words, part)).otherwise(F.array(F.struct(kind.alias("kind"), mention.alias("value"))))


def _space(kind: Column, canon: Column) -> Column:
    """What a number must have in common with one whose digits it takes over: kind, country code, count of digits and whether the check digit is right."""
    valid = F.when(kind == "card", F.pmod(_luhn(_digits(canon)), F.lit(10)) == 0).otherwise(False)
    code = F.when(canon.startswith("+"), F.substring_index(canon, " ", 1)).otherwise("")
    length = F.when(kind == "ip", 0).otherwise(F.length(_digits(canon)))
    return F.concat_ws(" ", kind, code, length.cast("string"), valid.cast("string"))


def attempts(entities: DataFrame, key: str, most: int = 8) -> DataFrame:
    """(kind, canon, attempt, other) of the entities whose first surrogate is another's, or is itself an entity.

    Of entities that ask for one free surrogate the smallest gets it and keeps it, and only
    the rest try again, so all surrogates are distinct and none is a canonical form found
    in the texts. Emails and names grow with the attempts until all have one. Numbers keep
    their length, so a space can have fewer free values than entities, the more so the
    shorter they are: those still without one after `most` attempts take over the
    value of the next such entity of their space, around in a circle. These values do
    occur in the texts, but are no one else's surrogate. An entity left alone in its space
    changes with the first one that had got a surrogate there.
    """
    entities = written(entities.where("kind <> 'as_is'").select("kind", "canon").distinct(), "entities")
    group = F.when(F.col("kind").startswith("given"), "given").otherwise(F.col("kind"))
    grows = (F.col("kind") == "email") | F.col("kind").startswith("given") | (F.col("kind") == "surname")
    real = entities.select(group.alias("group"), F.col("canon").alias("made")).distinct()
    todo, got, stuck, attempt = entities, [], [], 0
    while True:
        asked = todo.select("kind", "canon", F.lit(attempt).alias("attempt"), F.lit(None).cast("string").alias("other"))
        made = with_surrogate(asked, key, "canon").select("kind", "canon", "attempt", "other", group.alias("group"), F.lower("new").alias("made"))
        made = written(made, "surrogates")
        first = made.groupBy("group", "made").agg(F.min(F.struct("kind", "canon")).alias("keep")).select("keep.kind", "keep.canon", "group", "made")
        for taken in [real, *(g.select("group", "made") for g in got)]:
            first = first.join(taken, ["group", "made"], "left_anti")
        got.append(written(first.withColumn("attempt", F.lit(attempt)), "accepted"))
        todo = written(made.join(got[-1], ["kind", "canon"], "left_anti").select("kind", "canon"), "collisions")
        attempt += 1
        if attempt == most:
            stuck.append(todo.where(~grows))
            todo = todo.where(grows)
        if todo.isEmpty():
            break
    all_got = reduce(DataFrame.unionByName, got)
    again = all_got.where("attempt > 0").select("kind", "canon", "attempt", F.lit(None).cast("string").alias("other"))
    if not stuck or stuck[0].isEmpty():
        return again
    left = stuck[0].withColumn("space", _space(F.col("kind"), F.col("canon")))
    alone = left.groupBy("space").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("space")
    partner = all_got.select("kind", "canon", _space(F.col("kind"), F.col("canon")).alias("space")).join(alone, "space", "left_semi").groupBy("space").agg(F.min(F.struct("kind", "canon")).alias("p"))
    ring = grouped(left.unionByName(partner.select("p.kind", "p.canon", "space")), "space", "canon")
    follows = ring.select("g", F.pmod(F.col("i") - 1, F.col("n")).alias("i"), F.col("canon").alias("other"))
    swapped = written(ring.join(follows, ["g", "i"]).select("kind", "canon", F.lit(attempt).alias("attempt"), "other"), "swapped")
    return again.join(swapped, ["kind", "canon"], "left_anti").unionByName(swapped)


def pseudonymised(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_entities) for each row: detected entities replaced by surrogates.

    Emails, IPv4 addresses, phone, card and social security numbers and names (after a
    title, a listed given name before a surname, or two capitalised words beside what
    people do or how they are addressed, with initials and particles) are replaced. Equal entities get equal
    surrogates in all documents, different ones different surrogates. Letters stay
    letters of their script and case, separators, country codes, top-level domains,
    valid check digits and titles stay, given names keep their gender. `key` decides the
    mapping. Texts without an entity come back as they are, null ones as empty ones;
    repeated rows come back each; an empty table gives an empty result.

    Rows without an entity are never shuffled; of the others the mentions are joined to
    the few entities that needed another attempt, then put back into their texts.
    """
    rows = texts(docs, id_col, text_col).withColumn("hint", F.col("text").rlike(HINT))
    found = F.when(F.col("hint"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    rows = rows.select("doc_id", "text", F.coalesce(found, F.array().cast("array<string>")).alias("mentions"))
    clean = rows.where("size(mentions) = 0").select("doc_id", "text", F.lit(0).alias("n_entities"))
    held = written(rows.where("size(mentions) > 0").withColumn("row_key", row_key()), "entity-texts")
    mentions = held.select("row_key", F.posexplode("mentions").alias("pos", "mention"))
    mentions = mentions.select("row_key", "pos", F.posexplode(_parts(F.col("mention"))).alias("sub", "part")).select("row_key", "pos", "sub", "part.kind", "part.value")
    mentions = mentions.withColumn("canon", canonical(F.col("kind"), F.col("value")))
    again = attempts(mentions, key)
    named = mentions.join(again, ["kind", "canon"], "left").withColumn("attempt", F.coalesce("attempt", F.lit(0)))
    named = with_surrogate(named, key, "value").select("row_key", "pos", "sub", "new")
    by_mention = named.groupBy("row_key", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("sub", "new"))), lambda x: x["new"]), " ").alias("new"))
    by_row = by_mention.groupBy("row_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"]).alias("new"))
    pieces = F.split("text", ANY, -1)
    text = F.array_join(F.zip_with(pieces, "new", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    done = held.join(by_row, "row_key").select("doc_id", text.alias("text"), F.size("mentions").alias("n_entities"))
    return reduce(DataFrame.unionByName, [clean, done])
