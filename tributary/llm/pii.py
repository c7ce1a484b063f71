"""Surrogates for personal data, with DataFrame functions only.

Entities are found by one alternation of patterns. An entity's kind and normal form (digits of a
number, lower-case letters of an address or name) decide its surrogate: a keyed SHA-512 stream maps
digits to digits and letters to letters of the same case and script and leaves all separators, so
the same person or number gets the same surrogate everywhere, in whatever format it is written.
Names keep their title; given names come out in the gender that the title tells, composed of
syllables of the entity's script. Addresses go to ranges that nobody owns (class E, ``2001:db8``, ``.example``).

Collision check: over all distinct entities, a surrogate that equals an entity met in the corpus,
or that an earlier entity (in the order of kind and normal form) has as well, is drawn anew with the next attempt
number, until none is left. Only entities with an attempt above 0 are joined back to documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.texts import whole
from tributary.scratch import Scratch

#: Used when no key is given; a real run passes its own secret.
DEMO_KEY = "demonstration key, not a secret"
ATTEMPTS = 64

# Titles by the gender they tell.
_MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "г-н", "κ")
_FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Signora", "г-жа", "κα")
_OPEN = ("Dr", "Prof")

_TITLE = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(sorted(_MALE + _FEMALE + _OPEN, key=len, reverse=True))})\.?"
# Particles of surnames. A name begins with a capital or a letter without case, after particles.
_PARTICLES = ("van der", "van den", "von der", "van", "von", "de la", "de", "del", "della", "di", "da", "dos", "du", "le", "la", "ter", "zu", "al", "bin", "ibn")
_NAME_START = rf"(?:(?:{'|'.join(_PARTICLES)})[ -])?[\p{{Lu}}\p{{Lo}}]"
_NAME = _NAME_START + r"[\p{L}\p{M}]*+(?:['’-][\p{L}\p{M}]++)*+"
#: Kind and Java pattern, in the order in which they are tried at a place.
PATTERNS = {
    "secret": r"(?<![A-Za-z0-9_])(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}[\"']?[A-Za-z0-9+/_.-]{8,}+",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "aws_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "ip6": r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]{0,39}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])",
    "hex": r"(?<![A-Za-z0-9])(?=[a-f0-9]{0,63}[0-9])(?=[a-f0-9]{0,63}[a-f])(?:[a-f0-9]{40}|[a-f0-9]{64}|[a-f0-9]{32})(?![A-Za-z0-9])",
    "name": _TITLE + rf" {_NAME}(?: {_NAME})?",
}
#: Only texts with one of these can hold an entity; a linear look before the alternation.
_GATE = r"[0-9@]|[=:][ \t]*[\"']?[A-Za-z0-9+/_.-]{8}|" + _TITLE + " " + _NAME_START
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values()).replace(r"([ -]?)", r"(?<sep>[ -]?)").replace(r"\1", r"\k<sep>")

# Syllables by script (Latin, Cyrillic, Greek) and the gendered endings of given names.
_SYLLABLES = {
    "latin": ("ba", "de", "fi", "go", "la", "me", "ni", "ro", "sa", "te", "vi", "lo", "ka", "re", "mi", "no"),
    "cyrillic": ("ба", "де", "фи", "го", "ла", "ме", "ни", "ро", "са", "те", "ви", "ло", "ка", "ре", "ми", "но"),
    "greek": ("βα", "δε", "φι", "γο", "λα", "με", "νι", "ρο", "σα", "τε", "βι", "λο", "κα", "ρε", "μι", "νο"),
    "han": ("林", "森", "明", "海", "文", "山", "川", "安", "和", "春", "秋", "金", "石", "云", "天", "华"),
    "hiragana": ("あ", "か", "さ", "た", "な", "は", "ま", "や", "ら", "み", "き", "し", "ち", "に", "の", "も"),
    "katakana": ("ア", "カ", "サ", "タ", "ナ", "ハ", "マ", "ヤ", "ラ", "ミ", "キ", "シ", "チ", "ニ", "ノ", "モ"),
    "hangul": ("가", "나", "다", "라", "마", "바", "사", "아", "자", "하", "미", "수", "지", "민", "호", "영"),
    "arabic": ("با", "دي", "في", "كا", "لا", "مي", "ني", "رو", "سا", "تو", "وي", "لو", "كي", "ري", "ما", "نو"),
    "hebrew": ("בא", "די", "פי", "גו", "לא", "מי", "ני", "רו", "סא", "תי", "וי", "לו", "קא", "רי", "מא", "נו"),
    "devanagari": ("बा", "दे", "फी", "गो", "ला", "मे", "नी", "रो", "सा", "ते", "वी", "लो", "का", "रे", "मी", "नो"),
}
_ENDINGS = {
    "latin": {"male": "n", "female": "na", "open": "l"},
    "cyrillic": {"male": "н", "female": "на", "open": "л"},
    "greek": {"male": "ν", "female": "να", "open": "λ"},
    "han": {"male": "", "female": "美", "open": ""},
    "hiragana": {"male": "お", "female": "こ", "open": ""},
    "katakana": {"male": "オ", "female": "コ", "open": ""},
    "hangul": {"male": "", "female": "희", "open": ""},
    "arabic": {"male": "", "female": "ة", "open": ""},
    "hebrew": {"male": "", "female": "ה", "open": ""},
    "devanagari": {"male": "", "female": "ा", "open": ""},
}


def _kind(e: Column) -> Column:
    """The first kind whose pattern an entity is."""
    tests = [F.when(e.rlike(rf"^(?:{p})$"), F.lit(kind)) for kind, p in PATTERNS.items()]
    return F.coalesce(*tests, F.lit("phone"))


def _part(e: Column, pattern: str) -> Column:
    return F.regexp_extract(e, pattern, 0)


#: Particles go with the name they belong to, so a body has one or two words.
_PARTICLE_LEAD = rf"(^| )(?:{'|'.join(_PARTICLES)})[ -](?=[\p{{Lu}}\p{{Lo}}])"
_SECRET_LEAD = r"^.*?[=:][ \t]*[\"']?"
_TITLE_LEAD = rf"^.*?(?= {_NAME_START})"


def _body(kind: Column, e: Column) -> Column:
    """What of an entity is replaced: the value of a secret, the words after a title, else everything."""
    return (
        F.when(kind == "secret", F.regexp_replace(e, _SECRET_LEAD, ""))
        .when(kind == "name", F.trim(F.regexp_replace(e, _TITLE_LEAD, "")))
        .otherwise(e)
    )


def _normal(kind: Column, body: Column) -> Column:
    """What two writings of one entity have in common."""
    return (
        F.when(kind.isin("card", "ssn"), F.regexp_replace(body, "[^0-9]", ""))
        .when(kind == "phone", F.right(F.regexp_replace(body, "[^0-9]", ""), F.lit(10)))
        .when(kind.isin("email", "name", "ip6"), F.lower(body))
        .when(kind == "iban", F.replace(body, F.lit(" "), F.lit("")))
        .when(kind == "ip", F.regexp_replace(body, r"(?<![0-9])0+(?=[0-9])", ""))
        .otherwise(body)
    )


def _stream(key: str, kind: Column, normal: Column, attempt: Column, part: str = "") -> Column:
    """256 keyed hexadecimal digits."""
    seed = F.concat_ws("\x1f", F.lit(key), F.lit(part), kind, normal, attempt.cast("string"))
    return F.concat(*(F.sha2(F.concat(F.lit(f"{i}\x1f"), seed).cast("binary"), 512) for i in range(2)))


def _byte(stream: Column, at: Column) -> Column:
    return F.conv(F.substr(stream, (at * 2) % 256 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(choices: str, number: Column) -> Column:
    return F.substr(F.lit(choices), number % len(choices) + 1, F.lit(1))


def _mapped(surface: Column, stream: Column, hexes: Column, skip: Column) -> Column:
    """``surface`` with digits and letters mapped but for the first ``skip``; the n-th of the others uses the n-th byte, so separators don't matter."""
    chars = F.filter(F.split(surface, ""), lambda c: c != "")
    byte = lambda s: _byte(stream, s["n"] - skip)
    done = F.aggregate(
        chars,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("n")),
        lambda s, c: F.struct(
            F.concat(
                s["out"],
                F.when(~c.rlike(r"[\p{L}0-9]") | (s["n"] < skip), c)
                .when(c.rlike("[0-9]"), _pick("0123456789", byte(s)))
                .when(hexes & c.rlike("[a-f]"), _pick("abcdef", byte(s)))
                .when(c.rlike(r"\p{Lu}"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", byte(s)))
                .otherwise(_pick("abcdefghijklmnopqrstuvwxyz", byte(s))),
            ).alias("out"),
            (s["n"] + c.rlike(r"[\p{L}0-9]").cast("int")).alias("n"),
        ),
    )
    return done["out"]


def _gender(e: Column) -> Column:
    title = F.regexp_replace(_part(e, _TITLE_LEAD), r"\.$", "")
    return F.when(title.isin(*_MALE), "male").when(title.isin(*_FEMALE), "female").otherwise("open")


def _name_word(word: Column, stream: Column, attempt: Column, ending: Callable[[str], Column]) -> Column:
    """Four syllables in the script of ``word``, one more with each attempt so that free names never run out, the first letter large.

    A hyphenated name stays one: two more syllables after the hyphen.
    """
    name = F.coalesce(*(F.when(word.rlike(rf"\p{{Is{s.capitalize()}}}"), F.lit(s)) for s in _SYLLABLES if s != "latin"), F.lit("latin"))
    tables = F.create_map(*(x for s, all_of in _SYLLABLES.items() for x in (F.lit(s), F.array(*map(F.lit, all_of)))))
    syllable = lambda i: F.element_at(tables[name], _byte(stream, i) % len(_SYLLABLES["latin"]) + 1)
    spell = lambda first, last: F.array_join(F.transform(F.sequence(first, last), syllable), "")
    more = F.when(attempt > 0, spell(F.lit(4), attempt + 3)).otherwise("")
    end = F.coalesce(*(F.when(name == s, ending(s)) for s in _SYLLABLES))
    second = F.when(word.contains("-"), F.concat(F.lit("-"), F.initcap(spell(F.lit(100), F.lit(101))))).otherwise("")
    return F.concat(F.initcap(F.concat(spell(F.lit(0), F.lit(3)), more, end)), second)


def _name(x: Column) -> Column:
    words = F.split(F.regexp_replace(x["body"], _PARTICLE_LEAD, "$1"), " ")
    last, first, gender = F.element_at(words, -1), F.element_at(words, 1), _gender(x["e"])

    def ending(script: str) -> Column:
        of = _ENDINGS[script]
        return F.when(gender == "male", of["male"]).when(gender == "female", of["female"]).otherwise(of["open"])

    surname = _name_word(last, x["last"], x["attempt"], lambda script: F.lit(""))
    return F.when(F.size(words) > 1, F.concat_ws(" ", _name_word(first, x["first"], x["attempt"], ending), surname)).otherwise(surname)


def _new(x: Column) -> Column:
    """The replacement of one writing, from the fields that :func:`_worked` has put together."""
    e, kind, body, normal, stream = (x[c] for c in ("e", "kind", "body", "normal", "stream"))
    local = _mapped(F.substring_index(body, "@", 1), stream, F.lit(False), F.lit(0))
    mail = F.concat(local, F.lit("@m"), F.substr(x["last"], F.lit(1), F.lit(8)), F.lit(".example"))
    octets = [_byte(stream, F.lit(i)).cast("string") for i in range(1, 4)]
    ip = F.concat_ws(".", (F.lit(240) + _byte(stream, F.lit(0)) % 15).cast("string"), *octets)
    digits = F.length(F.regexp_replace(body, "[^0-9]", ""))
    lead = F.when(kind == "aws_key", 4).when(kind == "phone", F.greatest(digits - 10, F.lit(0))).when(kind == "iban", 2).otherwise(0)
    hexes = (kind == "hex") | ((kind == "secret") & ~body.rlike("[^a-f0-9]"))
    groups = [F.substr(stream, F.lit(17 + 4 * i), F.lit(4)) for i in range(6)]
    ip6 = F.concat_ws(":", F.lit("2001"), F.lit("db8"), *groups)
    new = F.when(kind == "email", mail).when(kind == "ip6", ip6).when(kind == "ip", ip).when(kind == "name", _name(x)).otherwise(_mapped(body, stream, hexes, lead))
    return F.concat(F.substr(e, F.lit(1), F.length(e) - F.length(body)), new)


def _worked(rows: DataFrame, column: str, key: str, attempt: Callable[[Column, Column], Column]) -> DataFrame:
    """``rows`` with the writings in the array ``column`` turned into structs that end in ``new``, the surrogate.

    Each step is a projection of its own, so that no expression holds another one many times.
    """

    def step(rows: DataFrame, names: tuple[str, ...], *fields: Callable[[Column], Column]) -> DataFrame:
        add = lambda x: F.struct(*(x[n].alias(n) for n in names), *(f(x) for f in fields))
        return rows.withColumn(column, F.transform(column, add))

    rows = rows.withColumn(column, F.transform(column, lambda e: F.struct(e.alias("e"), _kind(e).alias("kind"))))
    rows = step(rows, ("e", "kind"), lambda x: _body(x["kind"], x["e"]).alias("body"))
    names = ("e", "kind", "body")
    rows = step(rows, names, lambda x: _normal(x["kind"], x["body"]).alias("normal"))
    names += ("normal",)
    rows = step(rows, names, lambda x: attempt(x["kind"], x["normal"]).alias("attempt"))
    names += ("attempt",)

    def stream(x: Column) -> Column:
        return _stream(key, x["kind"], x["normal"], x["attempt"]).alias("stream")

    def last(x: Column) -> Column:
        name = _stream(key, F.lit("surname"), F.element_at(F.split(x["normal"], " "), -1), x["attempt"])
        domain = _stream(key, F.lit("domain"), F.substring_index(x["normal"], "@", -1), x["attempt"])
        return F.when(x["kind"] == "name", name).when(x["kind"] == "email", domain).alias("last")

    def first(x: Column) -> Column:
        return F.when(x["kind"] == "name", _stream(key, F.lit("given"), F.substring_index(x["normal"], " ", 1), x["attempt"])).alias("first")

    rows = step(rows, names, stream, last, first)
    return step(rows, names, lambda x: _new(x).alias("new"))


def found(text: Column) -> Column:
    """The entities of a text, as written, in their order; empty for a null text."""
    none = F.array().cast("array<string>")
    return F.when(text.rlike(_GATE), F.regexp_extract_all(text, F.lit(f"({_ANY})"), F.lit(0))).otherwise(none)


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct ``kind, normal`` of all whole texts; repeats are counted out before the shuffle."""
    return _normals(docs.select(F.explode(found(whole(text_col))).alias("e"))).distinct()


def _normals(rows: DataFrame) -> DataFrame:
    """``kind, normal`` for the entity ``e`` of each row, with the other columns."""
    others = [c for c in rows.columns if c != "e"]
    rows = rows.withColumn("kind", _kind(F.col("e")))
    rows = rows.withColumn("body", _body(F.col("kind"), F.col("e")))
    return rows.select(*others, "kind", _normal(F.col("kind"), F.col("body")).alias("normal"))


def attempts(known: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """``kind, normal, attempt`` of the entities whose first surrogate was taken.

    ``known`` is a stored table of distinct entities. A surrogate is compared in normal form.
    """
    e, kind = F.col("normal"), F.col("kind")

    def drawn(rows: DataFrame) -> DataFrame:
        written = F.when(kind == "name", F.concat(F.lit("Dr "), F.initcap(e))).when(kind == "secret", F.concat(F.lit("secret="), e)).otherwise(e)
        rows = _worked(rows.withColumn("x", F.array(written)), "x", key, lambda k, n: F.col("attempt"))
        new = F.col("x")[0]["new"]
        return rows.select("kind", "normal", "attempt", _normal(kind, _body(kind, new)).alias("new"))

    real = known.select(kind, e.alias("new"), F.lit(True).alias("real"))
    open_rows, settled = known.withColumn("attempt", F.lit(0)), None
    for n in range(ATTEMPTS):
        taken = real if settled is None else real.unionByName(settled.select("kind", "new", F.lit(True).alias("real")))
        rows = scratch.save(drawn(open_rows), f"drawn-{n}")
        first = rows.groupBy("kind", "new").agg(F.min("normal").alias("normal"))
        good = first.join(taken, ["kind", "new"], "left_anti").join(rows.select("kind", "normal", "attempt"), ["kind", "normal"])
        good = scratch.save(good.select("kind", "normal", "attempt", "new"), f"good-{n}")
        settled = good if settled is None else settled.unionByName(good)
        open_rows = rows.join(good, ["kind", "normal"], "left_anti").select("kind", "normal", (F.col("attempt") + 1).alias("attempt"))
        open_rows = scratch.save(open_rows, f"open-{n}")
        if open_rows.isEmpty():
            return settled.filter("attempt > 0").select("kind", "normal", "attempt")
    raise ValueError(f"no free surrogate after {ATTEMPTS} attempts; the space of a kind is too small for its entities")


def pseudonymize(docs: DataFrame, key: str = DEMO_KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every entity in ``text_col`` replaced by its surrogate; all other columns and rows stay.

    Null texts stay null, empty ones empty, texts without entities are unchanged. Repeated rows get
    equal replacements; null ids are allowed. Works on whole texts. A column of ``docs`` whose name
    begins with ``__pii`` raises.
    """
    if any(c.startswith("__pii") for c in docs.columns):
        raise ValueError("column names that begin with __pii are taken")
    scratch = Scratch(docs.sparkSession, "pii")
    known = scratch.save(entities(docs, text_col), "entities")
    again = scratch.save(attempts(known, key, scratch), "again")
    text = F.col(text_col)
    rows = docs.withColumn("__pii_found", found(whole(text)))
    if again.isEmpty():
        attempt = lambda kind, normal: F.lit(0)
    else:
        # by id and text: rows that share an id, or have none, don't share a map
        digest = lambda: F.sha2(whole(text).cast("binary"), 256)
        spots = docs.select(F.col(id_col).alias("__pii_id"), digest().alias("__pii_text"), F.explode(found(whole(text))).alias("e"))
        entry = F.struct(F.concat_ws("\x1f", "kind", "normal"), "attempt")
        maps = _normals(spots).distinct().join(again, ["kind", "normal"])
        maps = maps.groupBy("__pii_id", "__pii_text").agg(F.map_from_entries(F.collect_list(entry)).alias("__pii_map"))
        rows = rows.withColumn("__pii_own", digest())
        rows = rows.join(maps, F.col(id_col).eqNullSafe(F.col("__pii_id")) & (F.col("__pii_own") == F.col("__pii_text")), "left")
        attempt = lambda kind, normal: F.coalesce(F.try_element_at("__pii_map", F.concat_ws("\x1f", kind, normal)), F.lit(0))

    rows = _worked(rows, "__pii_found", key, attempt)
    gaps = F.split(text, _ANY, -1)
    put = lambda x, i: F.concat(x["new"], F.element_at(F.col("__pii_gaps"), i + 2))
    rows = rows.withColumn("__pii_gaps", F.when(F.size("__pii_found") > 0, gaps))
    new = F.concat(F.element_at("__pii_gaps", 1), F.array_join(F.transform("__pii_found", put), ""))
    rows = rows.withColumn(text_col, F.when(F.size("__pii_found") > 0, new).otherwise(text))
    return rows.select(*docs.columns)
