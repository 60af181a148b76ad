"""Surrogates for personal data, in DataFrame functions alone.

One pattern finds e-mail addresses, phone, card, account and social security
numbers, network addresses, secrets and titled names. Every distinct entity of
the corpus gets one surrogate that depends on a key: of its type, with its
format (digits for digits, letters for letters, check sums kept), its script
and the gender that its titles show. The entities of names are their words, so
a person keeps one surname with and without a given name, and a document's
titled names are replaced where they stand without a title, too. Surrogates
that meet each other or a real entity are drawn again, and longer after a few
draws, so distinct entities stay distinct, and equal ones stay equal across
documents.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: Titles and the gender they show; those of the second table stand behind a name.
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Don", "Signor", "Sir", "Господин", "Κύριος", "السيد", "מר"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Doña", "Signora", "Госпожа", "Κυρία", "السيدة", "גברת"),
    "n": ("Dr", "Prof", "Professor", "الدكتور"),
}
BEHIND = {"m": ("先生",), "f": ("女士", "小姐"), "n": ("博士", "教授")}
TITLE = "(?:" + "|".join(sorted((t for ts in TITLES.values() for t in ts), key=lambda t: (-len(t), t))) + r")\.?"
LAST_TITLE = "(?:" + "|".join(t for ts in BEHIND.values() for t in ts) + ")"
#: Words of a name: up to three with a capital, two of Han signs, one of another script without case.
WORDS = r"(?:\p{Lu}[\p{L}\p{M}'’-]++(?: \p{Lu}[\p{L}\p{M}'’-]++){0,2}|\p{IsHan}{1,4}(?: \p{IsHan}{1,3})?|[\p{Lo}&&\P{IsHan}][\p{L}\p{M}]++)"
NAME = rf"(?<![\p{{L}}\p{{N}}]){TITLE} {WORDS}|\p{{IsHan}}{{2,3}}(?={LAST_TITLE})"
VALUE = r"[^\s\"',;]{6,}+"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # what follows a colon behind a common word is a secret only if it looks like one
    "secret": rf"(?<=[=:\"\s])(?:(?<=(?i:password|passwd|pwd|api[_-]?key)\s?[=:]\s?\"?){VALUE}|(?<=(?i:secret|token)\s?=\s?\"?){VALUE}|(?<=(?i:secret|token)\s?:\s?\"?)(?=[^\s\"',;]*[0-9\p{{Lu}}+/=_]){VALUE})",
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{12,}+(?![A-Za-z0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "ip": rf"(?<![0-9A-Za-z.])(?<!(?i:version|release|firmware|build|rev|v)[ .:])(?<!(?i:version|release|firmware|build): ){OCTET}(?:\.{OCTET}){{3}}(?!\.?[0-9])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|0[0-9]{2,4}[ /-][0-9]{3,4}[ -]?[0-9]{3,5})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z-])",
    "name": NAME,
}
ALL = "|".join(PATTERNS.values())
DIGIT_TYPES = ("phone", "ssn", "card")
#: Given names by script and gender; surnames, and further given names before these, are made of syllables.
GIVEN = {
    "Latin": {"m": ("Adam", "Bruno", "Carl", "Daniel", "Emil", "Felix", "Hugo", "Ivan"), "f": ("Anna", "Bella", "Clara", "Diana", "Emma", "Fiona", "Greta", "Ida"), "n": ("Alex", "Kim", "Robin", "Sam", "Toni", "Noel", "Jules", "Sasha")},
    "Cyrillic": {"m": ("Антон", "Борис", "Виктор", "Глеб"), "f": ("Анна", "Вера", "Дарья", "Ирина"), "n": ("Саша", "Женя", "Валя", "Шура")},
    "Greek": {"m": ("Άρης", "Νίκος", "Πέτρος", "Σταύρος"), "f": ("Άννα", "Ελένη", "Μαρία", "Σοφία"), "n": ("Αλέξης", "Φώτης", "Χάρις", "Ευ")},
    "Arabic": {"m": ("سامي", "عادل", "كريم", "نادر"), "f": ("سلمى", "ليلى", "نور", "هند"), "n": ("صباح", "نهاد", "رضا", "وسام")},
    "Hebrew": {"m": ("דוד", "יוסף", "משה", "אורי"), "f": ("שרה", "רחל", "לאה", "מרים"), "n": ("נועם", "טל", "גל", "שחר")},
}
SYLLABLES = {
    "Latin": ("ba", "de", "fi", "go", "ku", "la", "me", "ni", "po", "ru", "sa", "te", "vi", "wo", "zu", "ler"),
    "Cyrillic": ("ба", "де", "фи", "го", "ку", "ла", "ме", "ни", "по", "ру", "са", "те", "ви", "во", "зу", "лер"),
    "Greek": ("βα", "δε", "φι", "γο", "κου", "λα", "με", "νι", "πο", "ρου", "σα", "τε", "βι", "ξο", "ζου", "λερ"),
    "Arabic": ("با", "دي", "في", "غو", "كو", "لا", "مي", "ني", "بو", "رو", "سا", "تي", "وي", "زو", "شا", "لر"),
    "Hebrew": ("בא", "די", "פי", "גו", "קו", "לא", "מי", "ני", "פו", "רו", "סא", "טי", "וי", "זו", "שא", "לר"),
}
HAN = "山水火木金土日月天地人石田竹米雨雪風花草"

#: Letters and digits beyond ASCII become ones of their script and case, those of other scripts small Latin letters.
LETTERS = (
    (r"^[\p{IsCyrillic}&&\p{Ll}]$", "абвгдежзийклмнопрстуфхцчшщъыьэюя"), (r"^[\p{IsCyrillic}&&\p{Lu}]$", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"),
    (r"^[\p{IsGreek}&&\p{Ll}]$", "αβγδεζηθικλμνξοπρστυφχψω"), (r"^[\p{IsGreek}&&\p{Lu}]$", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    (r"^\p{IsHan}$", "山水火木金土日月天地人口手目耳心石田竹米門雨雪風花草鳥魚馬牛羊犬"), (r"^\p{Lu}$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (r"^[\p{L}\p{M}]$", "abcdefghijklmnopqrstuvwxyz"), (r"^\p{N}$", "0123456789"),
)
#: Draws that hold the length of an entity; each later one is two characters longer than the one before.
EXACT_DRAWS = 4


def may_hold(text: Column) -> Column:
    """True for every text that a pattern can match, by plain searches: a sign, a digit or a title.

    The patterns look behind and around each place; most texts need not pay for that.
    """
    plain = [F.contains(text, F.lit(x)) for x in ("@", "=", ":", "AKIA")]
    titled = [F.contains(text, F.lit(t + end)) for ts in TITLES.values() for t in ts for end in (" ", ". ")]
    behind = [F.contains(text, F.lit(t)) for ts in BEHIND.values() for t in ts]
    return reduce(lambda a, b: a | b, [*plain, text.rlike("[0-9]"), *titled, *behind])


def kind_of(found: Column) -> Column:
    """Type of a match: the first pattern that it fits alone; values that only stand after a key word are secrets."""
    kinds = [F.when(found.rlike(rf"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items() if k not in ("secret", "name")]
    name = F.when(found.rlike(rf"^(?:{TITLE} {WORDS}|\p{{IsHan}}{{2,3}})$"), F.lit("name"))
    return F.coalesce(*kinds, name, F.lit("secret"))


def entity_of(found: Column) -> Column:
    """True for a match that is an entity: a card number is one if its check sum holds."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    return ~found.rlike(rf"^(?:{PATTERNS['card']})$") | (_luhn_sum(digits) % 10 == 0)


def normal_form(kind: Column, found: Column) -> Column:
    """What makes two mentions the same entity: case for addresses and names, and separators for numbers, do not."""
    return (
        F.when(kind.isin(*DIGIT_TYPES), F.regexp_replace(found, "[^0-9]", ""))
        .when(kind.isin("email", "ipv6"), F.lower(found))
        .when(kind == "iban", F.replace(found, F.lit(" "), F.lit("")))
        .when(kind == "name", F.lower(F.regexp_replace(found, rf"^{TITLE} ", "")))
        .otherwise(found)
    )


def _byte(digest: Column, i: Column) -> Column:
    return F.conv(F.substring(digest, 1 + 2 * (i % 64), F.lit(2)), 16, 10).cast("int")


def _chars(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def _same_format(text: Column, digest: Column) -> Column:
    """Each digit becomes a digit, each letter a letter of its case (of a-f if all of the text is hexadecimal).

    Other signs stay, unless they are most of the text: they are what is secret then, and become letters.
    """
    spread = F.when(text.rlike("^[0-9a-f]+$"), F.lit(6)).otherwise(F.lit(26))
    signs = F.length(F.regexp_replace(text, r"[\p{L}\p{M}\p{N}]", "")) * 2 > F.length(text)

    def one(c: Column, i: Column) -> Column:
        b = _byte(digest, i)
        small = F.char(F.lit(97) + b % spread)
        out = F.when(c.rlike("^[0-9]$"), (b % 10).cast("string")).when(c.rlike("^[a-z]$"), small).when(c.rlike("^[A-Z]$"), F.char(F.lit(65) + b % 26))
        for pattern, letters in LETTERS:
            out = out.when(c.rlike(pattern), F.substring(F.lit(letters), b % len(letters) + 1, F.lit(1)))
        return out.when(signs, small).otherwise(c)

    return F.array_join(F.transform(_chars(text), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum, the last digit counting once."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _digits(kind: Column, norm: Column, digest: Column, country: Column, more: Column) -> Column:
    """As many digits and ``more``: a country code stays, the first free digit is not 0, a valid card stays valid."""
    free = F.concat(F.substring(norm, country + 1, F.length(norm)), F.repeat(F.lit("0"), more))
    first = (F.lit(1) + _byte(digest, F.lit(63)) % 9).cast("string")
    made = F.concat(F.substring(norm, F.lit(1), country), first, F.substring(_same_format(free, digest), F.lit(2), F.length(free)))
    open_card = F.concat(F.substring(made, F.lit(1), F.length(made) - 1), F.lit("0"))
    valid_card = F.concat(F.substring(made, F.lit(1), F.length(made) - 1), ((F.lit(10) - _luhn_sum(open_card) % 10) % 10).cast("string"))
    return F.when((kind == "card") & (_luhn_sum(norm) % 10 == 0), valid_card).otherwise(made)


def _word(norm: Column, gender: Column, digest: Column, attempt: Column) -> Column:
    """A word of a name in the script of ``norm``: one that is a given name (it has a gender) ends like one of that gender."""
    han = F.array_join(F.transform(F.sequence(F.lit(1), F.length(norm) + F.greatest(attempt - 2, F.lit(0))), lambda i: F.substring(F.lit(HAN), _byte(digest, i) % len(HAN) + 1, F.lit(1))), "")

    def made(s: str) -> Column:
        syllables = F.array(*map(F.lit, SYLLABLES[s]))
        run = lambda n: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.get(syllables, _byte(digest, i) % 16)), "")
        pick = lambda g: F.get(F.array(*map(F.lit, GIVEN[s][g])), _byte(digest, F.lit(60)) % len(GIVEN[s][g]))
        given = F.when(gender == "m", pick("m")).when(gender == "f", pick("f")).otherwise(pick("n"))
        given = F.when(attempt == 0, given).otherwise(F.concat(run(attempt), given))
        return F.initcap(F.when(gender.isNotNull(), given).otherwise(run(attempt + 3)))

    out = F.when(norm.rlike(r"^\p{IsHan}"), han)
    for s in ("Cyrillic", "Greek", "Arabic", "Hebrew"):
        out = out.when(norm.rlike(rf"\p{{Is{s}}}"), made(s))
    return out.otherwise(made("Latin"))


def _iban(norm: Column, digest: Column, more: Column) -> Column:
    """The country and as many letters and digits, with a check sum that holds."""
    land = F.substring(norm, F.lit(1), F.lit(2))
    rest = _same_format(F.concat(F.substring(norm, F.lit(5), F.length(norm)), F.repeat(F.lit("0"), more)), digest)
    whole = F.concat(rest, land, F.lit("00"))
    digits = F.array_join(F.transform(_chars(whole), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    rem = F.aggregate(_chars(digits), F.lit(0), lambda acc, c: (acc * 10 + c.cast("int")) % 97)
    return F.concat(land, F.lpad((F.lit(98) - rem).cast("string"), 2, "0"), rest)


def surrogate(kind: Column, norm: Column, gender: Column, country: Column, key: str, attempt: Column) -> Column:
    """The ``attempt``-th surrogate of an entity, in normal form but for names (which are capitalised)."""
    digest = F.sha2(F.concat_ws("\0", F.lit(key), kind, norm, attempt.cast("string")), 512)
    local = F.regexp_extract(norm, "^([^@]*)@", 1)
    longer = F.substring(F.sha2(F.concat(digest, F.lit("+")), 256), F.lit(1), attempt * 2)
    mail = F.concat(_same_format(local, digest), longer, F.lit("@mail"), (_byte(digest, F.lit(62)) % 10).cast("string"), F.lit(".example."), F.get(F.array(F.lit("com"), F.lit("net"), F.lit("org")), _byte(digest, F.lit(61)) % 3))
    ip = F.concat_ws(".", *[(1 + _byte(digest, F.lit(i)) % 254).cast("string") for i in range(4)])
    more = F.greatest(attempt - (EXACT_DRAWS - 1), F.lit(0)) * 2
    tail = F.substring(F.sha2(F.concat(digest, F.lit("-")), 512), F.lit(1), more)
    aws = F.concat(F.lit("AKIA"), _same_format(F.substring(norm, F.lit(5), F.length(norm)), digest), F.upper(tail))
    # four numbers cannot grow: addresses that find none free get one of the range kept for documentation
    wide = F.concat(F.lit("2001:db8"), *[F.concat(F.lit(":"), F.substring(digest, F.lit(1 + 4 * i), F.lit(4))) for i in range(6)])
    ip = F.when(more > 0, wide).otherwise(ip)
    return (
        F.when(kind.isin(*DIGIT_TYPES), _digits(kind, norm, digest, country, more))
        .when(kind == "email", mail)
        .when(kind == "ip", ip)
        .when(kind == "key", aws)
        .when(kind == "ipv6", wide)
        .when(kind == "iban", _iban(norm, digest, more))
        .when(kind == "word", _word(norm, gender, digest, attempt))
        .otherwise(F.concat(_same_format(norm, digest), tail))
    )


def draw(entities: DataFrame, key: str) -> DataFrame:
    """``kind, norm, made`` for ``entities(kind, norm, gender, country)``: no two of a kind equal, none a real entity.

    Clashing ones but the first by normal form draw again; only their number
    comes to the driver. A format without room for all its entities is left for
    longer surrogates, whose number grows with every draw, so the draws end.
    """
    real = entities.select("kind", F.col("norm").alias("shape"))
    pending, done = entities, None
    for attempt in count():
        tried = pending.withColumn("made", surrogate(F.col("kind"), F.col("norm"), F.col("gender"), F.col("country"), key, F.lit(attempt)))
        tried = tried.withColumn("shape", F.lower("made")).withColumn("shape", F.when(F.col("kind").isin("email", "word"), F.col("shape")).otherwise(F.col("made")))
        taken = real if done is None else real.union(done.select("kind", "shape"))
        clash = tried.join(taken.withColumn("clash", F.lit(True)).distinct(), ["kind", "shape"], "left")
        order = F.row_number().over(Window.partitionBy("kind", "shape").orderBy("norm"))
        clash = written(clash.withColumn("ok", F.col("clash").isNull() & (order == 1)), "pii-draw")
        good = clash.where("ok").select("kind", "norm", "made", "shape")
        done = good if done is None else done.union(good)
        pending = clash.where("not ok").select("kind", "norm", "gender", "country")
        if pending.isEmpty():
            return done.select("kind", "norm", "made")


def _formatted(kind: Column, found: Column, made: Column) -> Column:
    """A surrogate in the format of one mention: its separators stand where they stood."""

    def fold(acc: Column, c: Column) -> Column:
        own = c.rlike("^[0-9]$") | ((kind == "iban") & c.rlike("^[A-Z]$"))
        return F.struct(F.concat(acc["out"], F.when(own, F.substring(made, acc["k"], F.lit(1))).otherwise(c)).alias("out"), (acc["k"] + own.cast("int")).alias("k"))

    filled = F.aggregate(_chars(found), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), fold, lambda a: F.concat(a["out"], F.substring(made, a["k"], F.length(made))))
    return F.when(kind.isin(*DIGIT_TYPES, "iban"), filled).otherwise(made)


def _surrogates(mentions: DataFrame, key: str) -> DataFrame:
    """``found, kind, new, alone`` of ``mentions(found, kind, norm, gender, country)``.

    ``alone`` holds what of a name may stand without its title, with what
    becomes of it: the whole name, and the surname where the script has capitals.
    """
    names = mentions.where("kind = 'name'")
    bare = F.regexp_replace("found", rf"^{TITLE} ", "")
    words = names.select("found", "gender", F.posexplode(F.split(bare, " ")).alias("at", "word"), F.size(F.split(bare, " ")).alias("of")).withColumn("norm", F.lower("word"))
    # titles that disagree leave the gender open; a word that is never a given name has none
    given = (F.col("at") == 0) & (F.col("of") > 1)
    told = F.when(given, F.col("gender"))
    word = words.groupBy("norm").agg(F.when(F.min(told) == F.max(told), F.min(told)).when(F.max(given), F.lit("n")).alias("gender"))
    word = word.select(F.lit("word").alias("kind"), "norm", "gender", F.lit(0).alias("country"))
    other = mentions.where("kind <> 'name'").groupBy("kind", "norm").agg(F.lit(None).cast("string").alias("gender"), F.max("country").alias("country"))
    made = draw(written(other.unionByName(word), "pii-entities"), key)
    plain = mentions.where("kind <> 'name'").join(made, ["kind", "norm"]).select("found", "kind", _formatted(F.col("kind"), F.col("found"), F.col("made")).alias("new"), F.array().cast("array<struct<old:string,new:string>>").alias("alone"))
    parts = words.join(made.where("kind = 'word'").select("norm", "made"), "norm").groupBy("found").agg(F.array_sort(F.collect_list(F.struct("at", "word", "made"))).alias("w"))
    whole = F.array_join(F.col("w.made"), " ")
    last = F.element_at("w", -1)
    surname = F.when((F.size("w") > 1) & last["word"].rlike(r"^\p{Lu}[\p{L}\p{M}'’-]+$"), F.struct(last["word"].alias("old"), last["made"].alias("new")))
    alone = F.array_compact(F.array(F.struct(F.array_join(F.col("w.word"), " ").alias("old"), whole.alias("new")), surname))
    titled = parts.select("found", F.lit("name").alias("kind"), F.concat(F.regexp_extract("found", rf"^({TITLE} )", 1), whole).alias("new"), alone.alias("alone"))
    return plain.unionByName(titled)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with entities of ``text_col`` replaced, plus ``n_entities`` (mentions) and ``kinds`` (sorted, distinct).

    Null texts stay null, empty ones empty; rows without entities are passed
    through. Repeated rows get equal replacements; rows may share an id or have
    none. All columns are kept; columns named as the added ones are replaced.
    An empty table gives an empty result. ``key`` decides all surrogates: the
    same key gives the same surrogates for the same corpus.
    """
    added = ("n_entities", "kinds")
    names = [c for c in docs.columns if c not in added]
    # everything that the input holds moves as one struct, so no name of it can clash
    rows = docs.select(F.struct(F.lit(0).alias("\0"), *[F.col(f"`{c}`") for c in names if c != text_col]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    text = F.coalesce("text", F.lit(""))
    has = may_hold(text) & text.rlike(ALL)
    # the pattern's one pass: documents with matches, which are few, are kept with them
    touched = rows.where(has).withColumns({"found": F.regexp_extract_all(text, F.lit(ALL), F.lit(0)), "h": F.sha2(text, 256)})
    touched = written(touched, "pii-touched")
    wanted = touched.select("h", F.explode(F.array_distinct("found")).alias("found")).distinct()
    mentions = wanted.select("found").distinct().where(entity_of(F.col("found"))).withColumn("kind", kind_of(F.col("found")))
    mentions = mentions.withColumn("norm", normal_form(F.col("kind"), F.col("found")))
    title = F.regexp_replace(F.when(F.col("kind") == "name", F.regexp_extract("found", rf"^({TITLE}) ", 1)), r"\.$", "")
    gender = reduce(lambda e, g: F.when(title.isin(*TITLES[g]), g).otherwise(e), ("m", "f"), F.lit(None).cast("string"))
    code = F.when(F.col("kind") == "phone", F.length(F.regexp_extract("found", r"^\+([0-9]{1,3})(?=[ .(-])", 1))).otherwise(F.lit(0))
    mentions = written(mentions.withColumn("gender", gender).withColumn("country", code), "pii-mentions")
    by_text = written(_surrogates(mentions, key), "pii-surrogates")
    # Documents meet the surrogates of their own mentions by a key of the text.
    own = wanted.join(by_text, "found").groupBy("h").agg(F.collect_list(F.struct("found", "new", "kind", "alone")).alias("own"))
    joined = touched.join(own, "h", "left").withColumn("own", F.coalesce("own", F.array().cast(own.schema["own"].dataType)))
    joined = joined.withColumn("news", F.map_from_arrays("own.found", "own.new"))
    # longer names first, so that a surname does not break up a name that holds it
    alone = F.array_sort(F.array_distinct(F.flatten("own.alone")), lambda x, y: F.length(y["old"]) - F.length(x["old"]))
    joined = joined.withColumn("alone", alone)

    def untitled(part: Column) -> Column:
        edge = lambda o: F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), o, F.lit(r"\E(?![\p{L}\p{N}])"))
        return F.aggregate("alone", part, lambda acc, o: F.when(F.contains(acc, o["old"]), F.regexp_replace(acc, edge(o["old"]), o["new"])).otherwise(acc))

    parts = F.split("text", ALL, -1)
    parts = F.when(F.size("alone") > 0, F.transform(parts, untitled)).otherwise(parts)
    new = F.array_join(F.zip_with(parts, F.transform("found", lambda m: F.coalesce(F.element_at("news", m), m)), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = joined.select("row", new.alias("text"), F.size(F.filter("found", lambda m: F.map_contains_key("news", m))).alias("n_entities"), F.array_sort(F.array_distinct("own.kind")).alias("kinds"))
    plain = rows.where(~has).select("row", "text", F.lit(0).alias("n_entities"), F.array().cast("array<string>").alias("kinds"))
    done = changed.unionByName(plain)
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in names], *added)
