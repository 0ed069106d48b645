"""Surrogates for personal data.

Detected entities (e-mail addresses, telephone numbers, IPv4 addresses, card numbers, social
security numbers, IBANs, names after a form of address) are replaced by made-up ones of the same
type. A replacement depends on a secret key, the entity's normal form and what else the corpus
holds, so an entity has the same one everywhere (coreference); it keeps the format (punctuation,
letter case, number of digits, top-level domain, country of an IBAN), the validity of check digits
(Luhn for cards, modulo 97 for IBANs) and, for names, gender and script (Latin, Cyrillic, Greek;
names in other scripts are not detected).

A dictionary of all distinct entities of the corpus is built first. Two entities of a kind that would
get the same replacement, or one that is a real entity of the corpus, are keyed again with a higher
attempt until none is left: replacements are distinct, as the entities are. A format with too few
values left is lengthened from the attempt SAME_LENGTH on. Only DataFrame expressions; the shuffles
carry entities, and texts only of documents that have one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import let, match_spans, replaced, written

_LETTER = "[\\p{IsLatin}\\p{IsCyrillic}\\p{IsGreek}]"
#: A word of a name: a capital and letters of the scripts that names are made in, with parts after
#: hyphens and apostrophes (but not an English genitive).
WORD = rf"(?=\p{{Lu}})(?:{_LETTER}{{2,}}|{_LETTER}(?=['’]\p{{L}}))(?:(?!['’]s(?!\p{{L}}))[-'’]{_LETTER}+){{0,8}}(?!\p{{L}})"
#: What each kind looks like, in the order in which overlaps are decided. Where a pattern
#: has a group, that is the entity. A search for an address starts once in a run of its characters (at
#: the run's start or behind another address) and keeps what it took, so its time is linear.
PATTERNS = {
    "email": (
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[._%+-]*+"
        r"([A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,})"
    ),
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": (
        r"(?<![0-9])(?:\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)[\x20.-]?)?[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,3}"
        r"|\([0-9]{3}\)\x20?[0-9]{3}[.-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])"
    ),
    "male": rf"\b(?:Mr\.?|Mister|Herr|Señor|Sr\.|Monsieur|M\.|Господин|Κύριος)\x20{WORD}(?:\x20{WORD})?",
    "female": rf"\b(?:Mrs\.?|Ms\.?|Miss|Frau|Señora|Señorita|Sra\.|Madame|Mme\.?|Mlle\.?|Госпожа|Κυρία)\x20{WORD}(?:\x20{WORD})?",
}
#: Country codes of one and two digits; all others have three.
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: The form of address, which stays.
ADDRESS = r"^\S+\x20"
#: Parts of made-up names: syllables, and the endings of given and family names by gender.
SYLLABLES = {
    "latin": "ba del fin gor hal kem lin mar nor pel ros sten tal ven wil zan".split(),
    "cyrillic": "ба вел гор дан зар кем лин мар нов пел рос сен тал фин хал чер".split(),
    "greek": "αν βασ γερ δημ ελ ζαν θεο καλ λαμ μαν νικ παπ ρου σταμ τσαλ χρι".split(),
}
GIVEN = {
    ("latin", "male"): "us an o ert".split(),
    ("latin", "female"): "a ina elle ia".split(),
    ("cyrillic", "male"): "ий ан ей ир".split(),
    ("cyrillic", "female"): "а ина ия ена".split(),
    ("greek", "male"): "ος ης ας ιος".split(),
    ("greek", "female"): "α η ια ινα".split(),
}
FAMILY = {"latin": {"male": "", "female": ""}, "cyrillic": {"male": "ов", "female": "ова"}, "greek": {"male": "ίδης", "female": "ίδου"}}
#: From this attempt on a replacement is a character longer with each attempt.
SAME_LENGTH = 8
MOST_ATTEMPTS = 1000
#: Entities in a task of the dictionary.
ENTITIES = 2000

_FOUND = "array<struct<start:bigint,rank:int,end:bigint,value:string,kind:string>>"


def entities(text: Column) -> Column:
    """Array of (start, rank, end, value, kind) by start.

    Of overlapping finds the first to start stays; of those, the kind listed first.
    """

    def of_kind(rank: int, kind: str) -> Column:
        return F.transform(
            match_spans(text, PATTERNS[kind], *((1, True) if kind == "email" else ())),
            lambda m: F.struct(m["start"], F.lit(rank).alias("rank"), m["end"], m["value"], F.lit(kind).alias("kind")),
        ).cast(_FOUND)

    found = F.array_sort(F.concat(*[of_kind(i, k) for i, k in enumerate(PATTERNS)]))
    init = F.struct(F.array().cast(_FOUND).alias("kept"), F.lit(0).cast("bigint").alias("at"))
    return F.aggregate(
        found,
        init,
        lambda acc, m: F.when(
            m["start"] >= acc["at"], F.struct(F.array_append(acc["kept"], m).alias("kept"), m["end"].alias("at"))
        ).otherwise(acc),
        lambda acc: acc["kept"],
    )


def normal_form(kind: Column, value: Column) -> Column:
    """What two mentions of one entity have in common."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", F.concat(F.when(value.startswith("+"), "+").otherwise(""), digits))
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .when(kind == "email", F.lower(value))
        .when(kind.isin("male", "female"), F.lower(F.regexp_replace(value, ADDRESS, "")))
        .otherwise(value)
    )


def _stream(key: Column, length: int = 96) -> Column:
    """length pseudo-random bytes for a key, as an array of ints."""
    hexed = F.concat(*[F.sha2(F.concat_ws("|", key, F.lit(str(i))), 256) for i in range(-(-length // 32))])
    one = lambda h: F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    return let(hexed, one)


def luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits modulo 10; 0 for valid numbers."""

    def worth(c: Column, i: Column) -> Column:
        v = c.cast("int")
        return F.when(i % 2 == 0, v).otherwise(v * 2 - F.when(v > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, v: a + v) % 10


def mod97(text: Column) -> Column:
    """Digits and capitals (A is 10) as one number modulo 97."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def surrogate(kind: Column, norm: Column, attempt: int, key: str) -> Column:
    """The replacement's normal form: keyed, of the same type and, before the attempt SAME_LENGTH, the same length."""
    longer = max(0, attempt - SAME_LENGTH + 1)

    def made(bytes_: Column) -> Column:
        # The stream is taken round after 96 characters, which no entity but a made-up address exceeds.
        at = lambda i: F.element_at(bytes_, (i % 96 + 1).cast("int"))
        letter = lambda first, b: F.chr((F.lit(first) + b % 26).cast("long"))
        code = F.length(F.regexp_extract(norm, COUNTRY, 0))

        def like(c: Column, i: Column) -> Column:
            return (
                F.when((kind == "phone") & (i < F.greatest(code, F.lit(1))), c)  # the country code, or a first digit
                .when(c.rlike("[0-9]"), (at(i) % 10).cast("string"))
                .when(c.rlike("[a-z]"), letter(97, at(i)))
                .when(c.rlike("[A-Z]"), letter(65, at(i)))
                .otherwise(c)
            )

        more = [at(F.lit(95 - j)) for j in range(longer)]
        shaped = F.concat(F.array_join(F.transform(F.split(norm, ""), like), ""), *[(b % 10).cast("string") for b in more])
        tld = F.regexp_extract(norm, r"\.[a-z]{2,}$", 0)
        body = F.substring(norm, F.lit(1), F.length(norm) - F.length(tld))
        email = F.concat(*[letter(97, b) for b in more], F.array_join(F.transform(F.split(body, ""), like), ""), tld)
        ip = F.array_join(F.transform(F.slice(bytes_, 1, 4), lambda b: b.cast("string")), ".")

        def card(digits: Column) -> Column:
            start = F.substring(digits, F.lit(1), F.length(digits) - 1)
            right = (10 - luhn(F.concat(start, F.lit("0")))) % 10
            last = F.when(luhn(norm) == 0, right).otherwise((right + 1 + at(F.lit(90)) % 9) % 10)
            return F.concat(start, last.cast("int").cast("string"))

        def iban(text: Column) -> Column:
            country, rest = F.substring(norm, 1, 2), F.substring(text, F.lit(5), F.length(text))
            valid = mod97(F.concat(F.substring(norm, F.lit(5), F.length(norm)), F.substring(norm, 1, 4))) == 1
            right = F.lpad((98 - mod97(F.concat(rest, country, F.lit("00")))).cast("string"), 2, "0")
            return F.concat(country, F.when(valid, right).otherwise(F.substring(text, 3, 2)), rest)

        def name(script: str, gender: str) -> Column:
            part = lambda b: F.get(F.array(*map(F.lit, SYLLABLES[script])), b % 16)
            given = F.initcap(F.concat(part(at(F.lit(0))), part(at(F.lit(1))), F.get(F.array(*map(F.lit, GIVEN[script, gender])), at(F.lit(2)) % 4)))
            # More syllables with each attempt: there are always new names.
            family = F.array_join(F.transform(F.slice(bytes_, 4, min(90, 2 + attempt)), part), "")
            family = F.initcap(F.concat(family, F.lit(FAMILY[script][gender])))
            second = F.initcap(F.concat(part(at(F.lit(91))), part(at(F.lit(92))), part(at(F.lit(93))), F.lit(FAMILY[script][gender])))
            family = F.when(norm.contains("-"), F.concat_ws("-", family, second)).otherwise(family)
            return F.when(norm.contains(" "), F.concat_ws(" ", given, family)).otherwise(family)

        script = F.when(norm.rlike(r"\p{IsCyrillic}"), "cyrillic").when(norm.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
        names = F.coalesce(*[F.when((script == x) & (kind == g), name(x, g)) for x, g in GIVEN])
        return (
            F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "iban", let(shaped, iban)).when(kind == "card", let(shaped, card))
            .when(kind.isin("male", "female"), names).otherwise(shaped)
        )

    return let(_stream(F.concat_ws("|", F.lit(key), kind, norm, F.lit(str(attempt)))), made)


def fill(kind: Column, value: Column, new: Column) -> Column:
    """A mention in the format of value: punctuation, spaces and, in addresses, letter case stay. What is longer goes before addresses and after numbers."""
    chars = F.split(value, "")
    numbers = F.regexp_replace(new, r"^\+", "")
    rank = lambda i, drop: F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), drop, ""))
    tail = lambda drop: F.substring(numbers, F.length(F.regexp_replace(value, drop, "")) + 1, F.length(new))
    digits = F.array_join(
        F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(numbers, rank(i, "[^0-9]"), F.lit(1))).otherwise(c)), ""
    )
    spaced = F.array_join(F.transform(chars, lambda c, i: F.when(c == " ", c).otherwise(F.substring(new, rank(i, " "), F.lit(1)))), "")
    more = F.length(new) - F.length(value)
    one = lambda i: F.substring(new, more + i + 1, F.lit(1))
    cased = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(one(i))).otherwise(one(i))), "")
    return (
        F.when(kind.isin("card", "ssn", "phone"), F.concat(digits, tail("[^0-9]")))
        .when(kind == "iban", F.concat(spaced, tail(" ")))
        .when(kind == "email", F.concat(F.substring(new, F.lit(1), more), cased))
        .when(kind.isin("male", "female"), F.concat(F.regexp_extract(value, ADDRESS, 0), new))
        .otherwise(new)
    )


def dictionary(found: DataFrame, key: str) -> DataFrame:
    """kind, norm, new for the distinct entities among found (kind, norm).

    Each attempt is one pass over the entities that have no replacement yet: a candidate is taken if
    it is no entity of the corpus, is not taken, and its entity is the first with that candidate.
    Making candidates costs far more than their bytes, so tasks are dealt by number of entities.
    Only IPv4 addresses cannot be lengthened: a corpus that holds nearly all 2**32 ends in an error.
    """
    todo = written(found.select("kind", "norm").distinct(), "pii-entities")
    taken = todo.select("kind", F.lower("norm").alias("new"))
    done = None
    for attempt in range(MOST_ATTEMPTS):
        spread = todo.repartition(max(1, -(-todo.count() // ENTITIES)))
        tried = spread.withColumn("new", surrogate(F.col("kind"), F.col("norm"), attempt, key))
        firsts = tried.groupBy("kind", F.lower("new").alias("low")).agg(F.min(F.struct("norm", "new")).alias("f"))
        firsts = firsts.join(taken.withColumnRenamed("new", "low"), ["kind", "low"], "left_anti")
        got = written(firsts.select("kind", "f.norm", "f.new"), "pii-surrogates")
        done = got if done is None else done.unionByName(got)
        todo = written(todo.join(got.select("kind", "norm"), ["kind", "norm"], "left_anti"), "pii-left")
        if todo.isEmpty():
            return done
        taken = taken.unionByName(got.select("kind", F.lower("new").alias("new")))
    raise RuntimeError(f"{MOST_ATTEMPTS} attempts did not give distinct surrogates")


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", report: bool = True) -> DataFrame:
    """docs, same columns, with all entities in text_col replaced. key is the secret: who has it can redo, not undo, the replacing.

    With report three columns follow: n_entities, entities (kind:start:end in the old text, comma-
    joined) and surrogates (array of the replacements in order). Columns of docs that have these names
    are an error then. Rows without an entity, null and empty texts among them, stay as they are;
    repeated rows are rows of their own with equal results; very long texts are replaced whole; an
    empty table gives no rows; other columns, whatever their names, come along unchanged.
    """
    if not key:
        raise ValueError("a key is needed")
    if report and {c.lower() for c in docs.columns} & {"n_entities", "entities", "surrogates"}:
        raise ValueError("docs has a column n_entities, entities or surrogates: rename it, or leave report out")
    text = F.col(f"`{text_col}`")
    rows = docs.withColumn("_fw_rid", F.monotonically_increasing_id()).withColumn("_fw_found", entities(F.coalesce(text, F.lit(""))))
    rows = written(rows, "pii-rows")
    hits, rest = rows.filter(F.size("_fw_found") > 0), rows.filter(F.size("_fw_found") == 0)
    mentions = hits.select("_fw_rid", F.explode("_fw_found").alias("m")).withColumns(
        {"kind": F.col("m.kind"), "norm": normal_form(F.col("m.kind"), F.col("m.value"))}
    )
    known = dictionary(mentions, key)
    put = fill(F.col("kind"), F.col("m.value"), F.col("new"))
    marks = (
        mentions.join(known, ["kind", "norm"])
        .groupBy("_fw_rid")
        .agg(F.array_sort(F.collect_list(F.struct("m.start", "m.end", put.alias("put"), "kind"))).alias("_fw_marks"))
    )
    hits = hits.join(marks, "_fw_rid").withColumn(text_col, replaced(text, F.col("_fw_marks")))
    kind = hits.schema["_fw_marks"].dataType
    both = hits.unionByName(rest.withColumn("_fw_marks", F.array().cast(kind)))
    more = [
        F.size("_fw_marks").cast("long").alias("n_entities"),
        F.array_join(
            F.transform("_fw_marks", lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ","
        ).alias("entities"),
        F.transform("_fw_marks", lambda m: m["put"]).alias("surrogates"),
    ]
    return both.select(*[F.col(f"`{c}`") for c in docs.columns], *(more if report else []))
