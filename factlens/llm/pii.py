"""PII surrogates (operator 9), DataFrame functions only.

Entities are found by one pattern, typed, and replaced by keyed surrogates of the same
type and format: an address stays an address (on a reserved host), a phone number keeps
its punctuation and country code, a card number stays valid under Luhn (and is found
among other digits by it: a run of digit groups is searched for whole groups of 13 to 19
digits; places that overlap are replaced as one), keys and tokens
keep length and character classes, and a name after a title keeps gender, script and the
case of its words. A name is replaced word by word, so "Mr Smith" and "Mr John Smith"
still share a family name; given names keep their gender.
The same entity (by its canonical form: letter case, punctuation and number format do
not count) gets the same surrogate in every document; different entities get different
ones. Surrogates are made once per distinct entity in a table of their own; that table is
checked for collisions (two entities, one surrogate; a surrogate that is itself an
entity of the corpus), and colliding entities draw again until none is left. Draws keep
the format first; those that still collide get longer ones with every round, so that a
format with few values cannot hold up the job.

Documents that cannot hold an entity (one cheap pattern) pass untouched in a narrow
pass; only the others meet the surrogates of their own entities.

Cases: null texts stay null; null ids are fine (rows are matched by a digest of id and text); repeated rows
are changed alike; entities are replaced wherever the pattern finds them, in texts of any length; all
columns are returned, ``text`` changed in place; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlens.llm.quality_rules import let
from factlens.llm.tables import stored

# Titles by gender, and given names by (script, gender).
MALE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Mlle", "г-жа")
GIVEN = {
    ("latin", "m"): ("Adam", "Bruno", "Carl", "Daniel", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Noel", "Oscar", "Paul", "Simon"),
    ("latin", "f"): ("Alice", "Bella", "Clara", "Diana", "Elena", "Flora", "Greta", "Helen", "Irene", "Julia", "Laura", "Maria", "Nora", "Olga", "Petra", "Sara"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Олег", "Павел", "Роман", "Семён", "Тимур", "Фёдор"),
    ("cyrillic", "f"): ("Алла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "София", "Юлия"),
}
SYLLABLES = {
    "latin": ("ba", "de", "fi", "go", "ha", "ke", "li", "mo", "na", "pe", "ri", "so", "ta", "ve", "wi", "zo"),
    "cyrillic": ("ба", "ве", "ги", "до", "жа", "зе", "ки", "ло", "ма", "не", "пи", "ро", "са", "те", "фи", "хо"),
}
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
US_PHONE = "(?<![0-9+])(?:\\+[0-9]{1,3}[ .-]?)?(?:\\([0-9]{3}\\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
COUNTRY = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
NAME = "\\p{Lu}\\p{L}{1,40}(?:-\\p{Lu}\\p{L}{1,40})?"
TYPES = {  # in the order they are tried
    "email": "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\\.[A-Za-z0-9-]{1,63}){0,6}\\.[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "secret": "(?i:(?<![a-z0-9])(?:token|password|passwd|pwd|secret|api[_-]?key)\\s{0,3}[=:]\\s{0,3}[\"']?(?=[_/+-]*+[A-Za-z0-9])[A-Za-z0-9_/+-]{8,}+)",
    "access_key": "(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": f"(?<![0-9.])(?:{OCTET}\\.){{3}}{OCTET}(?![0-9]|\\.[0-9])",
    "phone": US_PHONE,
    "ssn": "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "person": f"(?<!\\p{{L}})(?:{'|'.join(MALE + FEMALE)})\\.? {NAME}(?: {NAME}){{0,2}}",
}
# Runs of digits end where another entity begins.
_NEXT = "|".join(TYPES[k] for k in ("email", "ip", "phone", "ssn"))
TYPES["card"] = f"(?<![0-9])[2-6][0-9]{{3}}(?:[0-9]|[ -](?!{_NEXT})[0-9]){{9,}}+"
TYPES["phone_world"] = f"(?<![0-9A-Za-z+])\\+[1-9](?:(?:[ .()/-]{{1,2}}(?!{_NEXT}|{TYPES['card']}))?+[0-9]){{7,14}}(?![0-9])"
PATTERN = "|".join(TYPES.values())
#: What a found entity is by itself, without what stands beside it; the first that fits.
ALONE = {"phone_world": "\\+(?!1(?:[^0-9]*[0-9]){10}$)[1-9](?:[^0-9]{0,2}[0-9]){7,14}", "phone": "\\+1(?:[^0-9]{0,2}[0-9]){10}|" + US_PHONE, "card": "[2-6][0-9]{3}(?:[ -]?[0-9]){9,}+"}
ALONE |= {k: v for k, v in TYPES.items() if k not in ALONE}
#: A text without one of these characters or strings holds no entity (plain searches: cheap over long texts).
HINT_CHARS = "[0-9@=:]"
HINT_STRINGS = ("AKIA", "Mr", "Ms", "Miss", "Herr", "Frau", "Señor", "Sr", "Monsieur", "Madame", "Mme", "Mlle", "г-")
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
WORD_KINDS = {f"given_{g}_{s}": (s, g) for s, g in GIVEN} | {f"family_{s}": (s, None) for s in SYLLABLES}
ROUNDS = 20
#: Draws that keep the format: few of free text (local parts, secrets), more of numbers.
FREE_TURNS, FORMAT_TURNS = 3, 8


def may_hold(text: Column) -> Column:
    out = text.rlike(HINT_CHARS)
    for x in HINT_STRINGS:
        out = out | text.contains(x)
    return F.coalesce(out, F.lit(False))


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def _type(e: Column) -> Column:
    out = None
    for name, pattern in ALONE.items():
        test = e.rlike(_whole(pattern))
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out


def _digits(e: Column) -> Column:
    return F.regexp_replace(e, "[^0-9]", "")


def _luhn_sum(digits: Column, first_doubled: bool) -> Column:
    """Luhn sum of a digit string; ``first_doubled``: whether its last digit counts double."""
    back = F.split(F.reverse(digits), "")
    value = lambda c, i: F.when(i % 2 == (0 if first_doubled else 1), F.when(c > 4, 2 * c - 9).otherwise(2 * c)).otherwise(c)
    return F.aggregate(F.transform(back, lambda c, i: value(F.coalesce(c.try_cast("int"), F.lit(0)), i)), F.lit(0), lambda s, x: s + x)


def _marked(run: Column) -> Column:
    """A run of digit groups with <> around its card numbers."""
    def groups_of_card(s: Column) -> Column:
        found = (F.regexp_extract(s, f"^[2-6][0-9]{{3}}(?: ?[0-9]){{{n - 4}}}(?![0-9])", 0) for n in range(19, 12, -1))
        return F.coalesce(*(F.when((m != "") & (_luhn_sum(_digits(m), False) % 10 == 0), F.size(F.split(m, " "))) for m in found), F.lit(0))

    def shown(groups: Column, gaps: Column, upto: Column) -> Column:
        # a card has at most 16 groups, as its first one has 4 digits; upto: the group after the longest card that starts with this one
        covers = lambda i, n: F.coalesce(F.array_max(F.slice(upto, F.greatest(i - 15, F.lit(0)) + 1, n)), F.lit(0)) > i
        inner = lambda i: covers(i, F.least(i, F.lit(15)))
        return F.array_join(F.transform(groups, lambda g, i: F.concat(
            F.get(gaps, i), F.when((F.get(upto, i) > i) & ~inner(i), "<").otherwise(""), g,
            F.when(covers(i, F.least(i, F.lit(15)) + 1) & ~inner(i + 1), ">").otherwise(""))), "")

    def marked(groups: Column) -> Column:
        upto = F.transform(groups, lambda g, i: let(groups_of_card(F.array_join(F.slice(groups, i + 1, 16), " ")), lambda n: F.when(n > 0, i + n).otherwise(0)))
        return let(F.split(run, "[0-9]+", -1), lambda gaps: let(upto, lambda u: shown(groups, gaps, u)))

    return let(F.split(run, "[ -]"), marked)


def _canonical(e: Column, kind: Column) -> Column:
    return (F.when(kind == "email", F.lower(e)).when(kind == "phone", F.right(_digits(e), F.lit(10))).when(kind.isin("phone_world", "ssn"), _digits(e)).when(kind == "card", _marked(e))
            .when(kind == "iban", F.replace(e, F.lit(" "), F.lit(""))).when(kind == "secret", F.regexp_extract(e, "(?s)[=:]\\s*[\"']?(.*)$", 1))
            .when(kind == "person", _name(e)).otherwise(e))


def _name(e: Column) -> Column:
    return F.regexp_replace(e, "^[^ ]+ ", "")


def _byte(noise: Column, i: Column) -> Column:
    """Byte i of the keyed noise, which holds 64 of them."""
    return F.conv(F.substring(noise, 2 * (i % 64) + 1, F.lit(2)), 16, 10).cast("int")


def _pick(chars: str, n: Column) -> Column:
    return F.substring(F.lit(chars), n % len(chars) + 1, F.lit(1))


def _same_classes(value: Column, noise: Column, skip: int = 0) -> Column:
    """Every letter or digit drawn anew within its class; hexadecimal strings stay hexadecimal."""
    hexes = value.rlike("^[0-9a-f]+$")

    def drawn(c: Column, i: Column) -> Column:
        n = _byte(noise, i + skip)
        return (F.when(c.rlike("[0-9]"), _pick(DIGITS, n)).when(c.rlike("[a-z]"), F.when(hexes, _pick("abcdef", n)).otherwise(_pick(LOWER, n)))
                .when(c.rlike("[A-Z]"), _pick(UPPER, n)).otherwise(c))

    return F.array_join(F.transform(F.split(value, ""), drawn), "")


def _drawn_digits(n: Column, noise: Column, skip: int = 0) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: _pick(DIGITS, _byte(noise, i + skip))), "")


def _in_format(e: Column, digits: Column) -> Column:
    """``digits`` put where the digits of ``e`` stand; those beyond its last one follow it."""
    n = F.length(_digits(e))
    more = F.substr(digits, n + 1)
    place = F.zip_with(F.split(e, "[0-9]", -1), F.split(F.left(digits, n), ""), lambda gap, d: F.concat(gap, F.coalesce(d, F.lit(""))))
    last = F.size(place) - 1  # what follows the last digit of e
    return F.concat(F.array_join(F.slice(place, 1, last), ""), more, F.element_at(place, -1))


def _more(turn: Column, kept: int) -> Column:
    """How many characters a draw is longer than its format: none in the first ``kept`` turns, then ever more."""
    return F.greatest(F.lit(0), 2 * (turn - kept + 1))


def _tail(noise: Column, turn: Column, kept: int) -> Column:
    return F.substring(noise, F.lit(65), _more(turn, kept))


def _keyed(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)


def _draw(canon: Column, kind: Column, noise: Column, key: str) -> Column:
    """The canonical surrogate: what makes one entity differ from another. Hosts depend on the
    key and themselves alone, so a host keeps its surrogate in any address. Draws of late turns are longer."""
    turn = F.col("turn")
    extra = lambda skip: F.when(turn < FORMAT_TURNS, "").otherwise(_drawn_digits(F.greatest(_more(turn, FORMAT_TURNS), F.lit(1)), noise, skip))
    card = let(F.concat(F.left(canon, F.lit(1)), _drawn_digits(F.length(canon) - 2 + _more(turn, FORMAT_TURNS), noise)),
               lambda d: F.concat(d, ((F.lit(10) - _luhn_sum(d, True) % 10) % 10).cast("string")))
    phone = F.concat(_pick("23456789", _byte(noise, F.lit(0))), _drawn_digits(F.lit(2), noise, 1), _pick("23456789", _byte(noise, F.lit(3))), _drawn_digits(F.lit(6), noise, 4), extra(10))
    country = F.regexp_extract(canon, COUNTRY, 0)
    world = F.concat(country, _drawn_digits(F.length(canon) - F.length(country) + _more(turn, FORMAT_TURNS), noise))
    tld = F.regexp_extract(canon, "\\.(com|net|org)$", 1)
    host = F.concat(F.lit("h"), F.substring(_keyed(key, F.substring_index(canon, "@", -1)), 1, 8))
    local = let(_same_classes(F.substring_index(canon, "@", 1), noise), lambda x: F.when(turn < FREE_TURNS, x).otherwise(F.concat(F.left(x, F.lit(24)), _tail(noise, turn, FREE_TURNS))))
    email = F.concat(local, F.lit("@"), host, F.lit(".example"), F.when(tld != "", F.concat(F.lit("."), tld)).otherwise(F.lit("")))
    ip = F.when(turn < FORMAT_TURNS, F.array_join(F.array(*(F.lit(1) + _byte(noise, F.lit(i)) % 254 for i in range(4))).cast("array<string>"), ".")).otherwise(
        F.concat(F.lit("2001:db8:"), F.regexp_replace(F.substring(noise, 1, 24), "(.{4})(?=.)", "$1:")))  # the documentation range of IPv6
    iban = F.concat(F.left(canon, F.lit(2)), _same_classes(F.substr(canon, F.lit(3)), noise), F.upper(_tail(noise, turn, FORMAT_TURNS)))
    access = F.concat(F.lit("AKIA"), _same_classes(F.substr(canon, F.lit(5)), noise), F.upper(_tail(noise, turn, FORMAT_TURNS)))
    secret = F.concat(_same_classes(canon, noise), _tail(noise, turn, FREE_TURNS))
    words = _drawn_word(kind, noise, turn)
    return (F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "phone_world", world).when(kind == "card", card).when(kind == "ssn", F.concat(F.lit("9"), _drawn_digits(F.lit(8), noise), extra(8)))
            .when(kind == "ip", ip).when(kind == "iban", iban).when(kind == "access_key", access).when(kind.isin(*WORD_KINDS), words).otherwise(secret))


def _nibble(h: Column, i: int) -> Column:
    return F.conv(F.substring(h, i + 1, 1), 16, 10).cast("int")


def _drawn_word(kind: Column, noise: Column, turn: Column) -> Column:
    """One word of a name, in lower case. The first draw is a plain one; those that collided
    draw from ever wider sets (given names get a second part, family names more syllables)."""
    def pick(values, i: int) -> Column:
        return F.lower(F.get(F.array(*map(F.lit, values)), _nibble(noise, i)))

    out = None
    for name, (script, gender) in WORD_KINDS.items():
        tail = [pick(SYLLABLES[script], k) for k in range(2, 14)]
        if gender:
            first, second = pick(GIVEN[script, gender], 0), pick(GIVEN[script, gender], 1)
            drawn = F.when(turn == 0, first).when(turn == 1, F.concat_ws("-", first, second)).when(turn == 2, F.concat_ws("-", first, F.concat(*tail[:6]))).otherwise(F.concat_ws("-", first, F.concat(*tail)))
        else:
            drawn = F.when(turn == 0, F.concat(*tail[:4])).when(turn == 1, F.concat(*tail[:5])).when(turn == 2, F.concat(*tail[:6])).otherwise(F.concat(*tail))
        out = F.when(kind == name, drawn) if out is None else out.when(kind == name, drawn)
    return out


def _name_words(persons: DataFrame) -> DataFrame:
    """(entity, i, word, kind, canon): the words of each name with their kinds; the last one is the family name."""
    e, name = F.col("entity"), _name(F.col("entity"))
    gender = F.when(F.regexp_replace(F.substring_index(e, " ", 1), "\\.$", "").isin(*FEMALE), "f").otherwise("m")
    script = F.when(name.rlike("\\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    words = persons.select("entity", gender.alias("gender"), script.alias("script"), F.size(F.split(name, " ")).alias("n"), F.posexplode(F.split(name, " ")).alias("i", "word"))
    kind = F.when(F.col("i") == F.col("n") - 1, F.concat_ws("_", F.lit("family"), "script")).otherwise(F.concat_ws("_", F.lit("given"), "gender", "script"))
    return words.select("entity", "i", "word", kind.alias("kind"), F.lower("word").alias("canon"))


def _persons(words: DataFrame, canon: DataFrame) -> DataFrame:
    """(entity, kind, surrogate, n) of names put together again: title kept, words in the case of the original ones."""
    capital = F.array_join(F.transform(F.split("drawn", "-"), F.initcap), "-")
    shown = F.when((F.col("word") == F.upper("word")) & (F.length("word") > 1), F.upper("drawn")).otherwise(capital)
    parts = words.join(canon.select("kind", "canon", "drawn"), ["kind", "canon"]).groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("i", shown.alias("w")))).alias("x"))
    return parts.select("entity", F.lit("person").alias("kind"), F.concat_ws(" ", F.substring_index("entity", " ", 1), F.array_join("x.w", " ")).alias("surrogate"), F.lit(1).alias("n"))


def _card_parts(runs: DataFrame) -> DataFrame:
    """(entity, marked, i, part, kind, canon): the card numbers of each run of digits."""
    parts = runs.select("entity", F.col("canon").alias("marked"), F.posexplode(F.regexp_extract_all("canon", F.lit("<([^>]+)>"), F.lit(1))).alias("i", "part"))
    return parts.select("*", F.lit("card").alias("kind"), _digits(F.col("part")).alias("canon"))


def _runs(parts: DataFrame, canon: DataFrame) -> DataFrame:
    """(entity, kind, surrogate, n) of runs of digits with their card numbers replaced."""
    shown = _in_format(F.col("part"), F.col("drawn"))
    x = parts.join(canon.select("kind", "canon", "drawn"), ["kind", "canon"]).groupBy("entity", "marked").agg(F.array_sort(F.collect_list(F.struct("i", shown.alias("w")))).alias("x"))
    text = F.array_join(F.zip_with(F.split("marked", "<[^>]+>", -1), F.col("x.w"), lambda gap, w: F.concat(gap, F.coalesce(w, F.lit("")))), "")
    return x.select("entity", F.lit("card").alias("kind"), text.alias("surrogate"), F.size("x").alias("n"))


def _render(e: Column, kind: Column, drawn: Column) -> Column:
    """The canonical surrogate in the format of one occurrence."""
    d = _digits(e)
    iban = F.when(e.contains(" "), F.regexp_replace(drawn, "(.{4})(?=.)", "$1 ")).otherwise(drawn)
    return (F.when(kind == "phone", _in_format(e, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), drawn))).when(kind.isin("phone_world", "ssn"), _in_format(e, drawn))
            .when(kind == "secret", F.concat(F.regexp_extract(e, "(?s)^(.*?[=:]\\s*[\"']?)", 1), drawn)).when(kind == "iban", iban).otherwise(drawn))


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct entities as they stand in the corpus: entity, kind, canon (of a run of digits: the run with its cards marked)."""
    found = docs.where(may_hold(F.col(text_col))).select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(PATTERN), F.lit(0)))).alias("entity"))
    typed = found.groupBy("entity").agg(F.lit(1).alias("_")).select("entity", _type(F.col("entity")).alias("kind"))
    typed = typed.select("entity", "kind", _canonical(F.col("entity"), F.col("kind")).alias("canon"))
    return typed.where((F.col("kind") != "card") | F.col("canon").contains("<"))


def surrogates(found: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """(entity, kind, surrogate, n) without collisions, see the module; n: how many entities it stands for."""
    def draw(df: DataFrame) -> DataFrame:
        noise = F.concat(*(_keyed(key, F.lit(part), F.col("kind"), F.col("canon"), F.col("turn").cast("string")) for part in "ab"))
        return df.withColumn("drawn", let(noise, lambda n: _draw(F.col("canon"), F.col("kind"), n, key)))

    words, cards = stored(_name_words(found.where("kind = 'person'"))), stored(_card_parts(found.where("kind = 'card'")))
    others = found.where("kind not in ('person', 'card')")
    items = others.select("kind", "canon").unionByName(words.select("kind", "canon")).unionByName(cards.select("kind", "canon")).distinct()
    canon = stored(draw(items.withColumn("turn", F.lit(0))))
    group = F.when(F.col("kind").isin(*WORD_KINDS), "name").otherwise(F.col("kind"))  # a surrogate given name is no one's family name either
    known = canon.select(group.alias("group"), F.col("canon").alias("drawn")).distinct().withColumn("is_entity", F.lit(True))
    for _ in range(rounds):
        owner = canon.groupBy("kind", "drawn").agg(F.min("canon").alias("owner"), F.count("*").alias("n")).where("n > 1")
        checked = canon.withColumn("group", group).join(owner.select("kind", "drawn", "owner"), ["kind", "drawn"], "left").join(known, ["group", "drawn"], "left")
        clash = (F.col("owner").isNotNull() & (F.col("owner") != F.col("canon"))) | F.coalesce("is_entity", F.lit(False))
        again = checked.where(clash).select("kind", "canon", (F.col("turn") + 1).alias("turn"))
        if not again.head(1):
            break
        canon = stored(canon.join(again.select("kind", "canon"), ["kind", "canon"], "left_anti").unionByName(draw(again)))
    else:
        raise RuntimeError("surrogates still collide; the format of some type has too few values")
    plain = others.join(canon.select("kind", "canon", "drawn"), ["kind", "canon"]).select("entity", "kind", _render(F.col("entity"), F.col("kind"), F.col("drawn")).alias("surrogate"), F.lit(1).alias("n"))
    return plain.unionByName(_persons(words, canon)).unionByName(_runs(cards, canon))


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with every entity of ``text_col`` replaced; ``count_col`` adds their number."""
    mapping = stored(surrogates(stored(entities(docs, text_col)), key))
    t = F.col(f"d.{text_col}")
    hint = may_hold(F.col(text_col))
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)).cast("binary"))
    some = docs.where(hint).withColumn("__row", digest)
    place = (some.select("__row", F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(PATTERN), F.lit(0))).alias("i", "entity")).distinct()
             .join(mapping, "entity", "left").select("__row", F.struct("i", F.coalesce("surrogate", "entity").alias("s"), F.coalesce("n", F.lit(0)).alias("n")).alias("x")))
    lists = place.groupBy("__row").agg(F.array_sort(F.collect_list("x")).alias("__x"))
    gaps = F.split(t, PATTERN, -1)
    new = F.when(F.col("r.__x").isNull(), t).otherwise(
        F.array_join(F.zip_with(gaps, F.col("r.__x"), lambda g, x: F.concat(g, F.coalesce(x["s"], F.lit("")))), ""))
    extra = [F.coalesce(F.aggregate("r.__x", F.lit(0), lambda s, x: s + x["n"]), F.lit(0)).cast("long").alias(count_col)] if count_col else []
    changed = some.alias("d").join(lists.alias("r"), F.col("d.__row") == F.col("r.__row"), "left").select(
        *(new.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns), *extra)
    rest = docs.where(~hint).select(*(F.col(f"`{c}`") for c in docs.columns), *([F.lit(0).cast("long").alias(count_col)] if count_col else []))
    return rest.unionByName(changed)
