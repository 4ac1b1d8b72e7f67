"""Personal data replaced by surrogates, with built-in column functions only.

Detection: one regular expression finds e-mail addresses, IP addresses, phone,
card, account and social security numbers, secrets, and people's names after a
title or a common given name. ``split`` by it gives the text between.

Surrogates: an entity's canonical form (an address in lower case, a number's
digits, one part of a name) is mapped by a keyed hash to a surrogate of its
type and shape: letters become letters of the same script and case, digits
digits; IP octets stay octets; valid card numbers stay valid by Luhn's rule;
given names keep their gender. The mapping is a table of distinct entities,
so an entity is replaced alike in all documents (coreference), whatever its
format there: a phone number's new digits fill the places of the old ones.

Collision checks: surrogates that two entities of a type share, or that are
real entities of that type, are drawn again until none is left, so distinct
entities stay distinct. From draw LENGTHEN_AFTER on, each draw's surrogates are
one syllable (or two digits) longer than the draw's before, so that short names,
however many, find a free one.

Only documents with entities are joined with anything; one entity in very many
documents is a hot key of a plain join, which Spark may split.

Edge cases: null texts stay null and empty ones empty; a text without
entities is unchanged; overlapping candidates go to the leftmost, then to the
kind listed first; repeated rows are treated alike; other columns of any name
are carried along.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

LENGTHEN_AFTER = 12

# Titles and common given names, by gender.
TITLES = {
    "m": ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Mister", "Sir", "господин", "Господин", "г-н", "Κύριος", "κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Srta", "Madame", "Mme", "Mlle", "Madam", "Lady", "госпожа", "Госпожа", "г-жа", "Κυρία", "κυρία"),
    "n": ("Dr", "Prof", "Doctor", "Professor", "Доктор", "Δρ"),
}
GIVEN = {
    "m": (
        "James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Daniel", "Matthew", "Mark", "Paul", "Steven",
        "George", "Kevin", "Peter", "Hans", "Klaus", "Jürgen", "Wolfgang", "Stefan", "Pierre", "Jean", "Michel", "François", "Luc", "Juan", "Carlos", "José",
        "Miguel", "Pedro", "Luis", "Иван", "Сергей", "Алексей", "Дмитрий", "Михаил", "Γιώργος", "Νίκος",
    ),
    "f": (
        "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Nancy", "Lisa", "Margaret", "Sandra", "Emily",
        "Anna", "Emma", "Julia", "Petra", "Sabine", "Ursula", "Monika", "Marie", "Nathalie", "Isabelle", "Sophie", "Camille", "María", "Carmen", "Lucía",
        "Isabel", "Ana", "Мария", "Анна", "Елена", "Ольга", "Наталья", "Μαρία", "Ελένη",
    ),
}

_ANY = r"[\p{L}\p{N}]"
_CAP = r"\p{Lu}[\p{L}'’-]++"
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_GIVEN = "|".join(n for ns in GIVEN.values() for n in ns)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IP4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)"
_HEX4 = "[0-9A-Fa-f]{1,4}"
# the first characters are tried before any list of words
_SECRET_HEAD = r"(?=[aAcCpPsStT])(?i:api[_-]?key|access[_-]?key|auth[_-]?token|client[_-]?secret|private[_-]?key|secret|token|password|passwd|pwd)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"

_VALUE = r"[^\s\"'<>]"
_BEARER, _PEM = "[bB]earer ", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----\s{0,3}"
#: What stands before a secret's value and stays.
_HEADS = rf"(?:{_SECRET_HEAD}|{_BEARER}|{_PEM})"
# whole words that make a number another thing
_NOT = rf"(?<!{_ANY})"

#: Kind, pattern; in order of preference.
KINDS = (
    # up to a blank or quote; short ones hold a digit
    ("secret", rf"{_SECRET_HEAD}(?=[!-~]*[A-Za-z0-9])(?:{_VALUE}{{8,}}+|(?=[!-~]*[0-9]){_VALUE}{{4,}}+)"),
    ("secret", rf"{_BEARER}(?:(?=[\w.~+/=-]*\d)[\w.~+/=-]{{8,}}+|[\w.~+/=-]{{20,}}+)"),
    ("secret", rf"{_PEM}[A-Za-z0-9+/=]++(?:\s{{1,3}}[A-Za-z0-9+/=]++)*+"),
    ("email", r"(?<![._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)*\.\p{L}{2,}"),
    ("iban", rf"[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?(?!{_ANY})"),
    ("ip6", rf"(?={_HEX4}:[0-9A-Fa-f:]|::[0-9A-Fa-f])(?:(?:{_HEX4}:){{7}}{_HEX4}|(?:{_HEX4}:){{6}}{_IP4}|(?:{_HEX4}(?::{_HEX4}){{0,6}})?::(?:(?:{_HEX4}:){{0,6}}(?:{_IP4}|{_HEX4}))?)(?!{_ANY}|:[0-9A-Fa-f:])"),
    ("ip4", rf"(?<![.])(?<!{_NOT}[vV][ .])(?<!{_NOT}[vV]ersion ){_IP4}"),
    # before the kinds of digits, which would take the first digits of a hexadecimal key
    ("key", rf"(?:AKIA[0-9A-Z]{{16}}|gh[a-z]_[A-Za-z0-9]{{30,}}+|sk-[A-Za-z0-9_-]{{20,}}+|eyJ[\w-]{{10,}}+\.[\w-]{{10,}}+\.[\w-]{{10,}}+|[0-9a-f]{{32,}}+|[0-9A-F]{{32,}}+)(?!{_ANY})"),
    ("ssn", r"(?:SSN|[sS]ocial [sS]ecurity(?: [nN]umber)?)[ :#]{1,3}\d{3} \d{2} \d{4}(?!\d)"),
    ("ssn", r"(?<!-)\d{3}-\d{2}-\d{4}(?!-?\d)"),
    ("phone", r"(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)|(?<!(?<![\p{L}\p{N}])(?:[oO]rder|[iI]nvoice|[tT]icket|[iI]tem|[pP]art|[iI][dD]|[nN]o|[nN]r)[ :#.]{0,2})(?:1[2-9]\d{9}|[2-9]\d{9}|0\d{9,10})(?!\d)"),
    ("card", r"\d(?:[ -]?\d){12,18}(?!\d)"),
    ("titled", rf"(?=[\p{{Lu}}гκ])(?:{_TITLE})\.? {_CAP}(?: {_CAP})?"),
    ("named", rf"(?=\p{{Lu}})(?:{_GIVEN}) {_CAP}"),
)
PATTERN = rf"(?<!{_ANY})(?:" + "|".join(p for _, p in KINDS) + ")"
#: A text that this does not fit holds no entity.
GATE = rf"[0-9@]|(?=[\p{{Lu}}гκ])(?<!{_ANY})(?:{_TITLE}|{_GIVEN})\.? \p{{Lu}}|[=:](?<=[a-zA-Z][\"'\s]{{0,4}}[=:])|::[A-Fa-f]|{_BEARER}|PRIVATE KEY|AKIA|gh[a-z]_|sk-|eyJ|[a-f]{{32}}|[A-F]{{32}}"

_DIGITS = "0123456789"
_ALPHABETS = (
    ("[0-9]", _DIGITS), ("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (r"\p{IsCyrillic}&&\p{Lu}", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"),
    (r"\p{IsCyrillic}", "абвгдежзиклмнопрстуфхцчшэюя"), (r"\p{IsGreek}&&\p{Lu}", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"), (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"\p{IsHan}", "王李张刘陈杨黄赵周吴徐孙马朱胡林郭何高罗"), (r"\p{Lu}", "ÀÁÂÄÇÈÉÊËÍÎÑÓÔÖÚÜ"), (r"\p{L}", "àáâäçèéêëíîñóôöúü"),
)
_SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ka ke la le lo ma me mo na ne no ra re ro sa se ta te to va ve".split(),
    "cyrillic": "ба бе бо ва ве го да де до за ка ко ла ле ло ма ме мо на не но ра ре ро са се та те то фа".split(),
    "greek": "βα βε γα γο δα δε ζα θα θε κα κε κο λα λε λο μα με μο να νε νο πα πε ρα ρο σα σε τα τε τον".split(),
}
_ENDS = {"latin": {"f": "na", "m": "rd", "n": "ns"}, "cyrillic": {"f": "на", "m": "рт", "n": "нс"}, "greek": {"f": "να", "m": "ρος", "n": "ντης"}}


def _pick(alphabet: str, number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, alphabet)), (number % len(alphabet) + 1).cast("int"))


def _stream(key: str, kind: Column, canon: Column, draw: Column) -> Column:
    """64 keyed pseudo-random bytes as hexadecimal; longer values use them again."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, draw.cast("string")), 512)


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, i % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _like(text: Column, stream: Column) -> Column:
    """Each letter and digit replaced by one of its class."""

    def one(c: Column, i: Column) -> Column:
        # the place is mixed in, for values over 64 characters
        n = _byte(stream, i) + F.floor(i / 64).cast("int") * 7
        out = None
        for pattern, alphabet in _ALPHABETS:
            fits = F.regexp_like(c, F.lit(pattern if pattern[0] == "[" else f"[{pattern}]"))
            out = F.when(fits, _pick(alphabet, n)) if out is None else out.when(fits, _pick(alphabet, n))
        return out.otherwise(c)

    return F.array_join(F.transform(_chars(text), one), "")


def _hex_like(text: Column, stream: Column) -> Column:
    digits = F.transform(_chars(text), lambda c, i: _pick("0123456789abcdef", _byte(stream, i) + F.floor(i / 64).cast("int") * 7))
    out = F.array_join(digits, "")
    return F.when(F.regexp_like(text, F.lit("[A-F]")), F.upper(out)).otherwise(out)


def _luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a string of digits; a valid number's ends in 0."""
    doubled = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))


def _card_like(digits: Column, stream: Column) -> Column:
    fresh = F.concat(F.substring(digits, 1, 1), _like(F.expr("substring(canon, 2)"), stream))
    body = F.substring(fresh, F.lit(1), F.char_length(fresh) - 1)
    check = (F.lit(10) - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    return F.when(_luhn_sum(digits) % 10 == 0, F.concat(body, check.cast("string"))).otherwise(fresh)


def _name_like(kind: Column, canon: Column, stream: Column) -> Column:
    gender = F.element_at(F.split(kind, ":"), -1)

    def of(script: str) -> Column:
        parts = F.array(*map(F.lit, _SYLLABLES[script]))
        n = F.greatest(F.lit(1), F.least(F.lit(4), F.floor((F.char_length(canon) - 1) / 2).cast("int")))
        mid = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(parts, (_byte(stream, i) + 256 * _byte(stream, i + 20)) % len(_SYLLABLES[script]) + 1)), "")
        e = _ENDS[script]
        return F.concat(mid, F.when(gender == "f", e["f"]).when(gender == "m", e["m"]).otherwise(e["n"]))

    cyr, greek = F.regexp_like(canon, F.lit(r"\p{IsCyrillic}")), F.regexp_like(canon, F.lit(r"\p{IsGreek}"))
    other = F.regexp_like(canon, F.lit(r"^[\p{IsLatin}'’-]+$"))
    return F.when(cyr, of("cyrillic")).when(greek, of("greek")).when(other, of("latin")).otherwise(_like(canon, stream))


def _surrogate() -> Column:
    """From columns kind, canon, draw, stream, site_stream."""
    kind, canon, draw = F.col("kind"), F.col("canon"), F.col("draw")
    s, site_stream = F.col("stream"), F.col("site_stream")
    octets = F.transform(F.split(canon, r"\."), lambda o, i: (_byte(s, i) % 254 + 1).cast("string"))
    at = F.instr(canon, "@")
    top = F.element_at(F.split(canon, r"\."), -1)
    # zero groups stay, so that a short address stays short; all are drawn where too few addresses are of that shape
    sparse = (draw < LENGTHEN_AFTER) & F.regexp_like(canon, F.lit("[1-9a-f]"))
    made = (
        F.when(kind == "email", F.concat(_like(F.substring(canon, F.lit(1), at - 1), s), F.lit("@"), _like(F.expr("regexp_replace(substring(canon, instr(canon, '@') + 1), '[.][^.]*$', '')"), site_stream), F.lit("."), top))
        .when(kind == "ip4", F.array_join(octets, "."))
        .when(kind == "card", _card_like(canon, s))
        .when(kind == "phone", F.concat(F.substring(canon, 1, 1), _like(F.expr("substring(canon, 2)"), s)))
        .when(kind == "iban", F.concat(F.substring(canon, 1, 2), _like(F.expr("substring(canon, 3)"), s)))
        .when(kind.isin("secret", "key") & F.regexp_like(canon, F.lit("^(?:[0-9a-f]+|[0-9A-F]+)$")), _hex_like(canon, s))
        .when(kind == "ip6", F.array_join(F.transform(F.split(canon, ":"), lambda g, i: F.when((g == "0") & sparse, g).otherwise(F.lower(F.hex((_byte(s, i) + 256 * _byte(s, i + 20)) % 65535 + 1)))), ":"))
        .when(kind == "key", F.concat(F.regexp_extract(canon, "^(?:AKIA|gh[a-z]_|sk-|eyJ)?", 0), _like(F.expr("regexp_replace(canon, '^(?:AKIA|gh[a-z]_|sk-|eyJ)', '')"), s)))
        .when(kind.like("given%") | (kind == "family:n"), _name_like(kind, canon, s))
        .otherwise(_like(canon, s))
    )
    is_name = kind.like("given%") | (kind == "family:n")

    def syllable(i: Column) -> Column:
        a, b = _byte(s, 40 + 2 * i), _byte(s, 41 + 2 * i)
        return F.when(is_name, F.concat(_pick("aeiou", a), _pick("lmnrst", b))).otherwise(F.concat(_pick(_DIGITS, a), _pick(_DIGITS, b)))

    longer = F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), draw - LENGTHEN_AFTER)), syllable), "")
    tail = F.when((draw < LENGTHEN_AFTER) | (kind == "ip6"), "").otherwise(longer)
    # an address grows before its @
    return F.when(kind == "email", F.concat(F.substring_index(made, "@", 1), tail, F.lit("@"), F.substring_index(made, "@", -1))).otherwise(F.concat(made, tail))


def assign(entities: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(kind, canon) with ``surrogate``: within a kind distinct, and no entity itself."""
    known = scratch.write(entities.select("kind", "canon").distinct(), "entities")
    settled: list[DataFrame] = []
    open_ = known
    for draw in itertools.count():
        # a domain is mapped on its own, so that addresses of one site stay together
        site = F.expr("substring(canon, instr(canon, '@') + 1)")
        streams = {"draw": F.lit(draw), "stream": _stream(key, F.col("kind"), F.col("canon"), F.lit(draw)), "site_stream": _stream(key, F.lit("site"), site, F.lit(0))}
        # written, so that no hash is computed again for each character
        streams = scratch.write(open_.withColumns(streams), "streams")
        drawn = scratch.write(streams.select("kind", "canon", _surrogate().alias("surrogate")), "drawn")
        real = known.select("kind", F.col("canon").alias("surrogate"))
        taken = reduce(DataFrame.unionByName, [x.select("kind", "surrogate") for x in settled], real.select("kind", "surrogate"))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("canon").alias("winner"))
        free = first.join(taken, ["kind", "surrogate"], "left_anti")
        won = drawn.join(free, ["kind", "surrogate"]).where(F.col("canon") == F.col("winner")).select("kind", "canon", "surrogate")
        settled.append(scratch.write(won, "settled"))
        open_ = scratch.write(open_.join(settled[-1].select("kind", "canon"), ["kind", "canon"], "left_anti"), "open")
        if not open_.limit(1).count():
            return reduce(DataFrame.unionByName, settled)


def _kind(match: Column) -> Column:
    out = None
    for kind, pattern in KINDS:
        fits = F.regexp_like(match, F.lit(rf"^(?:{pattern})$"))
        out = F.when(fits, kind) if out is None else out.when(fits, kind)
    return out


def _ip6_groups(surface: Column) -> Column:
    """All groups of an address, in lower case and without leading zeros, joined by colons."""
    text = F.lower(surface)
    octets = F.transform(F.split(F.regexp_extract(text, r"[0-9.]*$", 0), r"\."), lambda o: o.try_cast("int"))
    pair = lambda i: F.lower(F.hex(F.get(octets, F.lit(i)) * 256 + F.get(octets, F.lit(i + 1))))
    text = F.when(F.contains(text, F.lit(".")), F.concat(F.regexp_replace(text, r"[0-9.]*$", ""), pair(0), F.lit(":"), pair(2))).otherwise(text)
    of = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    head, rest = of(F.element_at(F.split(text, "::"), 1)), of(F.coalesce(F.get(F.split(text, "::"), F.lit(1)), F.lit("")))
    zeros = F.array_repeat(F.lit("0"), F.when(F.contains(text, F.lit("::")), F.greatest(F.lit(0), 8 - F.size(head) - F.size(rest))).otherwise(0))
    return F.array_join(F.transform(F.concat(head, zeros, rest), lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")


def _ip6_short(groups: Column) -> Column:
    """The first of the longest runs of zero groups as ::."""
    out = None
    for n in range(8, 0, -1):
        run = rf"^(|.*?:)0(?::0){{{n - 1}}}(|:.*)$"
        fits, short = F.regexp_like(groups, F.lit(run)), F.regexp_replace(groups, run, "$1$2")
        out = F.when(fits, short) if out is None else out.when(fits, short)
    return F.regexp_replace(out.otherwise(groups), "^:(?!:)|(?<!:):$|^$", "::")


def _parts(kind: Column, surface: Column) -> Column:
    """The (kind, canonical form) of each part of an entity."""

    def part(k: Column | str, c: Column) -> Column:
        return F.struct((F.lit(k) if isinstance(k, str) else k).alias("kind"), c.alias("canon"))

    digits = F.regexp_replace(surface, r"\D", "")
    words = F.split(surface, " ")
    last = F.lower(F.element_at(words, -1))
    mid = F.lower(F.element_at(words, 2))
    first = F.element_at(words, 1)
    title = F.regexp_replace(first, r"\.$", "")
    gender = F.when(title.isin(*TITLES["m"]), "m").when(title.isin(*TITLES["f"]), "f").otherwise("n")
    own = F.when(F.lower(F.element_at(words, 2)).isin(*[n.lower() for n in GIVEN["m"]]), "m").when(F.lower(F.element_at(words, 2)).isin(*[n.lower() for n in GIVEN["f"]]), "f").otherwise(gender)
    value = F.regexp_replace(surface, rf"^{_HEADS}", "")
    # a North American number is the same with and without its country code
    number = F.when((F.char_length(digits) == 11) & digits.startswith("1"), F.regexp_replace(digits, "^1", "")).otherwise(digits)
    return (
        F.when(kind == "phone", F.array(part(kind, number)))
        .when(kind.isin("ssn", "card"), F.array(part(kind, digits)))
        .when(kind == "email", F.array(part("email", F.lower(surface))))
        .when(kind == "iban", F.array(part("iban", F.regexp_replace(surface, " ", ""))))
        .when(kind == "ip6", F.array(part("ip6", _ip6_groups(surface))))
        .when(kind == "secret", F.array(part("secret", value)))
        .when(kind == "named", F.array(part(F.concat(F.lit("given:"), F.when(first.isin(*GIVEN["m"]), "m").otherwise("f")), F.lower(first)), part("family:n", last)))
        .when((kind == "titled") & (F.size(words) > 2), F.array(part(F.concat(F.lit("given:"), own), mid), part("family:n", last)))
        .when(kind == "titled", F.array(part("family:n", last)))
        .otherwise(F.array(part(kind, surface)))
    )


def _fill(surface: Column, fresh: Column, digit: str) -> Column:
    """The surface with its characters of a class replaced, in order, by those of fresh."""
    chars = _chars(surface)
    at = F.transform(chars, lambda c, i: F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: F.regexp_like(x, F.lit(digit)))))
    return F.concat(
        F.array_join(F.zip_with(chars, at, lambda c, k: F.when(F.regexp_like(c, F.lit(digit)), F.substring(fresh, k, F.lit(1))).otherwise(c)), ""),
        F.substring(fresh, F.size(F.filter(chars, lambda x: F.regexp_like(x, F.lit(digit)))) + 1, F.char_length(fresh)),
    )


def _cased(surface: Column, fresh: Column) -> Column:
    upper = (F.upper(surface) == surface) & (F.char_length(surface) > 1)
    return F.when(upper, F.upper(fresh)).otherwise(F.initcap(fresh))


def _written(kind: Column, surface: Column, fresh: Column) -> Column:
    """The entity as it is to be written, from its surface and its parts' surrogates."""
    one, words = F.element_at(fresh, 1), F.split(surface, " ")
    last = F.element_at(fresh, -1)
    two = F.concat(_cased(F.element_at(words, -2), one), F.lit(" "), _cased(F.element_at(words, -1), last))
    head = F.regexp_extract(surface, rf"^{_HEADS}", 0)
    digits = F.regexp_replace(surface, r"\D", "")
    ip6 = F.when(F.contains(surface, F.lit("::")), _ip6_short(one)).otherwise(one)
    code = F.when(F.char_length(digits) > F.char_length(one), F.substring(digits, F.lit(1), F.char_length(digits) - F.char_length(one))).otherwise("")
    return (
        F.when(kind.isin("ssn", "phone", "card"), _fill(surface, F.concat(code, one), "[0-9]"))
        .when(kind == "iban", _fill(surface, one, "[A-Z0-9]"))
        .when(kind == "email", F.when(F.upper(surface) == surface, F.upper(one)).otherwise(one))
        .when(kind == "ip6", F.when(F.upper(surface) == surface, F.upper(ip6)).otherwise(ip6))
        .when(kind == "secret", F.concat(head, one))
        .when(kind == "named", two)
        .when((kind == "titled") & (F.size(words) > 2), F.concat(F.element_at(words, 1), F.lit(" "), two))
        .when(kind == "titled", F.concat(F.element_at(words, 1), F.lit(" "), _cased(F.element_at(words, -1), last)))
        .otherwise(one)
    )


def key_of(spark: SparkSession) -> str:
    """The secret key of the setting spark.tokenlake.pii.key; without it one for public test tables, from which anyone can rebuild the surrogates."""
    return spark.conf.get("spark.tokenlake.pii.key", "public test tables")


def replace(docs: DataFrame, scratch: Scratch, key: str) -> DataFrame:
    """Columns row (struct of all columns of docs but text), text (with surrogates) and n_entities; who has the key can tell surrogates of known values."""
    text = docs["text"].cast("string")
    df = docs.select(F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row"), text.alias("text"))
    found = F.when(F.regexp_like("text", F.lit(GATE)), F.regexp_extract_all("text", F.lit(PATTERN), 0)).otherwise(F.array().cast("array<string>"))
    some = F.coalesce(F.regexp_like("text", F.lit(GATE)) & F.regexp_like("text", F.lit(PATTERN)), F.lit(False))
    hits = scratch.write(df.where(some).withColumns({"rid": F.monotonically_increasing_id(), "found": found}), "hits")
    each = hits.select("rid", F.posexplode("found").alias("pos", "surface")).withColumn("as", _kind(F.col("surface")))
    each = scratch.write(each, "each")
    parts = each.select("rid", "pos", "surface", "as", F.posexplode(_parts(F.col("as"), F.col("surface"))).alias("i", "part"))
    parts = scratch.write(parts.select("rid", "pos", "surface", "as", "i", "part.kind", "part.canon"), "parts")
    mapped = parts.join(assign(parts, key, scratch), ["kind", "canon"])
    whole = mapped.groupBy("rid", "pos", "surface", "as").agg(F.sort_array(F.collect_list(F.struct("i", "surrogate"))).alias("fresh"))
    whole = scratch.write(whole.withColumn("fresh", F.col("fresh.surrogate")), "whole")
    written = whole.select("rid", "pos", _written(F.col("as"), F.col("surface"), F.col("fresh")).alias("new"))
    by_row = written.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("pos", "new"))).alias("new")).select(F.col("rid").alias("_rid"), F.col("new.new").alias("new"))
    by_row = scratch.write(by_row, "by-row")
    between = F.split("text", PATTERN, -1)
    new = F.array_join(F.zip_with(between, "new", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    done = hits.join(by_row, F.col("rid") == F.col("_rid")).select("row", new.alias("text"), F.size("found").cast("long").alias("n_entities"))
    rest = df.where(~some).select("row", "text", F.lit(0).cast("long").alias("n_entities"))
    return rest.unionByName(done)
