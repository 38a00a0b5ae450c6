r"""PII: surrogate generation.

Detected entities get replacements made from a keyed hash: the same entity gets the same one in every
document, different entities different ones, and none equals an entity of the corpus. A replacement has
the format, script, capitals and, for names after a title, the gender of what it stands for.

Kinds: email, phone (international, or ten digits in three groups), card (13 to 19 digits that pass the
Luhn test, whole or in the groups that cards have), iban (with right check digits), ssn, ip, ipv6, secret
(AWS key ids, and values after password, token and the like), person.

Persons are found by a title or `my name is`; or by weaker words that introduce a name (`Dear`, `Contact:`,
`I am`), if the corpus doesn't write the words that follow mostly in lower case. Their names are then
replaced wherever else they stand in the same document; in lower case only where the corpus writes them
mostly with capitals. Each word of a name is one entity, whatever its part in the name and whatever its
titles: it has one surrogate everywhere, of the gender that its titles say most often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.llm.text import let, unused
from lavra.sources.scratch import written

#: Rounds of surrogates for entities whose earlier ones collided.
ROUNDS = 40
#: From this round on, formats that may grow do, so that small ones are not exhausted.
GROW_FROM = 6
DEFAULT_KEY = "change me"
#: A name of fewer letters is only looked for with a capital first letter or in capitals: it may be a word.
SHORT_NAME = 4

_MALE = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Господин", "г-н")
_FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Señora", "Госпожа", "г-жа")
_EITHER = ("Dr", "Prof", "Professor", "Mx", "Доктор")
_forms = lambda titles: "|".join(dict.fromkeys(f for t in titles for f in (t, t.upper())))
_TITLE = rf"(?:{_forms((*_MALE, *_FEMALE, *_EITHER))})\.? (?:\p{{Lu}}\. ?){{0,2}}"
_NAME = r"\p{Lu}(?:\p{L}++(?:[-'’]\p{L}{2,}+)*+|['’]\p{L}{2,}+)"
_PARTICLE = r"(?: (?:van|von|der|den|de|del|di|da|do|dos|la|le|bin|al))"
_NAMES = rf"{_NAME}(?:{_PARTICLE}{{0,2}} {_NAME})?"
_SAID = r"(?i:my name is|this is|i am|i['’]m)\s{1,2}"
_SIGNED = r"(?i:dear|sincerely,|regards,|signed,?|name:|author:|contact:|attn:?)\s{1,2}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Alternatives in order of precedence. Each begins at a border that its own characters cannot cross, so
#: long runs of letters or digits are read once. None reads on into what no entity of its kind has, so one
#: that fails its test hides no other.
PATTERNS = {
    "email": r"(?<![\w.%+-])[\w.%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}+",
    "secret": r"""(?<![\w])(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,2}[=:]\s{0,2}["']?[^\s"']{6,}+|(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])""",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]\d{4}|\(\d{3}\) ?\d{3}-\d{4}|\+\d{8,15}|\+(?=(?:\D{0,2}\d){8})\d{1,3}(?:[ .-]\(?\d{1,5}\)?){2,6})(?!\d)"
    r"|(?<![\w.+-])\d{3}(?:-\d{3}-|\.\d{3}\.| \d{3} )\d{4}(?![\w-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![\w-])\d{3}(?:-\d{2}-| \d{2} )\d{4}(?![\w-])",
    "ipv6": rf"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![\w:])",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "card": r"(?<![\w.])(?:\d{13,19}|\d{4}(?:(?: \d{4}){3}|(?:-\d{4}){3}| \d{6} \d{4,5}|-\d{6}-\d{4,5}))(?!\w)",
    "person": rf"(?<![\p{{L}}])(?:{_TITLE}{_NAMES}|{_SAID}{_NAME}(?:{_PARTICLE}{{0,2}} {_NAME})|(?i:my name is)\s{{1,2}}{_NAME}|{_SIGNED}{_NAME}{_PARTICLE}{{0,2}} {_NAME})(?!\p{{L}})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Introductions that nothing but a name follows.
_SURE = rf"^(?:{_TITLE}|(?i:my name is))"
_BEFORE_NAME = rf"^((?:{_TITLE}|{_SAID}|{_SIGNED}))"

_LATIN_ON, _LATIN_VOW = "bdfgklmnprstvz", "aeiou"
_CYR_ON, _CYR_VOW = "бвгдзклмнпрст", "аеиоу"


def _mod97(text: Column) -> Column:
    """The number that the text spells modulo 97, letters standing for 10 to 35."""
    def step(total: Column, c: Column) -> Column:
        n = F.ascii(c)
        return F.when(n < 58, total * 10 + n - 48).otherwise(total * 100 + n - 55) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def kind_of(match: Column) -> Column:
    """The kind of a match of ANY; null for digits that are no card, or no iban."""
    packed = F.replace(match, F.lit(" "))
    out = F
    for kind, pattern in PATTERNS.items():
        test = match.rlike(rf"^(?:{pattern})$")
        if kind == "card":
            test = test & F.call_function("luhn_check", F.regexp_replace(match, r"\D", ""))
        if kind == "iban":
            test = test & (_mod97(F.concat(F.substr(packed, F.lit(5)), F.substr(packed, F.lit(1), F.lit(4)))) == 1)
        out = out.when(test, kind)
    return out


def names_in(match: Column) -> Column:
    """array<string>: the words of a person match that are names; titles, initials and particles are not."""
    return F.filter(F.split(F.regexp_replace(match, _BEFORE_NAME, ""), " "), lambda w: w.rlike(r"^\p{Lu}"))


def entities_of(match: Column, kind: Column) -> Column:
    """array<struct<kind, canonical, given, gender>>: what of a match is replaced, in a form that its spellings share.

    Each word of a person's name is an entity; `given` is whether another follows, gender m, f or u as the
    title says. Phones, cards and ssns are their digits.
    """
    digits = F.regexp_replace(match, r"\D", "")
    entity = lambda kind, value, given=F.lit(False), gender=F.lit("u"): F.struct(kind.alias("kind"), value.alias("canonical"), given.alias("given"), gender.alias("gender"))
    one = lambda value: F.array(entity(kind, value))
    gender = F.when(match.rlike(rf"^(?:{_forms(_FEMALE)})\.? "), "f").when(match.rlike(rf"^(?:{_forms(_MALE)})\.? "), "m").otherwise("u")
    script = lambda w: F.when(w.rlike(r"^\p{IsCyrillic}"), "name_cyrillic").otherwise("name")
    named = lambda words: F.transform(words, lambda w, i: entity(script(w), F.lower(w), i < F.size(words) - 1, gender))

    secret = F.when(match.startswith("AKIA"), match).otherwise(F.regexp_extract(match, r"""[=:]\s{0,2}["']?([^\s"']+)$""", 1))
    return (
        F.when(kind == "person", let(names_in(match), named)).when(kind.isin("phone", "card", "ssn"), one(digits)).when(kind.isin("email", "ipv6"), one(F.lower(match)))
        .when(kind == "iban", one(F.replace(match, F.lit(" ")))).when(kind == "secret", one(secret)).otherwise(one(match))
    )


def _noise(seed: Column, i: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(seed, i.cast("int")), F.lit(size)).cast("int")


def _pick(letters: str, seed: Column, i: Column) -> Column:
    return F.substr(F.lit(letters), _noise(seed, i, len(letters)) + 1, F.lit(1))


def _same_classes(value: Column, seed: Column, fixed: int = 0) -> Column:
    """Each character but the first `fixed` replaced by one of its class; letters of hexadecimal values stay hexadecimal."""
    hexadecimal = value.rlike("^[0-9a-f]+$")
    chars = F.split(value, "")
    return F.array_join(
        F.transform(
            chars,
            lambda c, i: F.when(i < fixed, c).when(c.rlike(r"\d"), _pick("0123456789", seed, i))
            .when(hexadecimal, _pick("abcdef", seed, i)).when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", seed, i))
            .when(c.rlike(r"\p{IsCyrillic}"), _pick(_CYR_ON + _CYR_VOW, seed, i)).when(c.rlike(r"\p{L}"), _pick("abcdefghijklmnopqrstuvwxyz", seed, i)).otherwise(c),
        ), "",
    )


def _digits(value: Column, seed: Column, fixed: int) -> Column:
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(i < fixed, c).when(i == fixed, _pick("23456789", seed, i)).otherwise(_pick("0123456789", seed, i))), "")


def _luhn_digit(body: Column) -> Column:
    """What makes body and it together pass the Luhn test."""
    n = F.char_length(body)
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(
        F.transform(F.split(body, ""), lambda c, i: let(c.cast("int"), lambda d: F.when((n - i) % 2 == 1, doubled(d)).otherwise(d))), F.lit(0), lambda a, x: a + x
    )
    return F.pmod(-total, F.lit(10)).cast("string")


def _name(seed: Column, onsets: str, vowels: str, parts: Column, ending: Column) -> Column:
    syllables = F.transform(F.sequence(F.lit(1), parts), lambda i: F.concat(_pick(onsets, seed, 2 * i), _pick(vowels, seed, 2 * i + 1)))
    return F.concat(F.array_join(syllables, ""), ending)


def surrogate(kind: Column, canonical: Column, attempt: Column, key: str, form: Column) -> Column:
    """The replacement, in canonical form, that the key and the attempt give an entity; form is given_ or surname_ and a gender for names."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, canonical, attempt.cast("string")), 256)
    more = F.greatest(attempt - GROW_FROM, F.lit(0))
    local, domain = F.substring_index(canonical, "@", 1), F.substring_index(canonical, "@", -1)
    tail = F.array_join(F.transform(F.sequence(F.lit(1), more), lambda i: _pick("abcdefghijklmnopqrstuvwxyz", seed, -i)), "")
    grown = F.when(more > 0, tail).otherwise("")
    top = F.regexp_extract(domain, r"\.([^.]+)$", 1)
    domain_seed = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain), 256)
    email = F.concat(_same_classes(local, seed), grown, F.lit("@"), _same_classes(F.regexp_replace(domain, r"\.[^.]+$", ""), domain_seed), F.lit("."), top)
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_noise(seed, i, 254) + 1).cast("string")), ".")
    card = let(_digits(F.expr("substring(canonical, 1, char_length(canonical) - 1)"), seed, 1), lambda body: F.concat(body, _luhn_digit(body)))
    ipv6 = F.array_join(F.transform(F.split(canonical, ""), lambda c, i: F.when(c == ":", c).otherwise(_pick("123456789abcdef", seed, i))), "")
    iban = let(
        F.concat(_same_classes(F.expr("substring(canonical, 5)"), seed), F.substr(canonical, F.lit(1), F.lit(2))),
        lambda body: F.concat(F.right(body, F.lit(2)), F.lpad((98 - _mod97(F.concat(body, F.lit("00")))).cast("string"), 2, "0"), F.substr(body, F.lit(1), F.char_length(body) - 2)),
    )
    parts = F.greatest(F.lit(2), F.least(F.lit(4), F.floor(F.char_length(canonical) / 3).cast("int"))) + more
    latin_end = F.when(form == "given_f", "a").when(form == "given_m", _pick("nrs", seed, F.lit(0))).otherwise(_pick("nrskt", seed, F.lit(0)))
    cyr_end = F.when(form == "surname_m", "ов").when(form == "surname_f", "ова").when(form == "given_f", "на").otherwise(_pick("нрм", seed, F.lit(0)))
    return (
        F.when(kind == "email", email).when(kind == "phone", _digits(canonical, seed, 1)).when(kind == "ssn", _digits(canonical, seed, 0))
        .when(kind == "card", card).when(kind == "ip", ip).when(kind == "ipv6", ipv6).when(kind == "iban", iban)
        .when(kind == "secret", F.concat(F.when(canonical.startswith("AKIA"), F.concat(F.lit("AKIA"), _same_classes(F.substr(canonical, F.lit(5)), seed))).otherwise(F.concat(_same_classes(canonical, seed), grown))))
        .when(kind == "name_cyrillic", _name(seed, _CYR_ON, _CYR_VOW, parts, cyr_end)).otherwise(_name(seed, _LATIN_ON, _LATIN_VOW, parts, latin_end))
    )


def assign(entities: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """Rows (kind, canonical, surrogate) for distinct entities (kind, canonical), with a form where they are names.

    Each round gives every open entity its next candidate. It is taken unless it equals an entity of the
    same kind in the corpus, or one given before; of equal candidates the smallest entity's is taken.
    The rest go on; each is counted and written, so the last round is the first without any left.
    """
    form = F.max("form") if "form" in entities.columns else F.lit(None).cast("string")
    entities = written(entities.groupBy("kind", "canonical").agg(form.alias("form")), "entities")
    done, todo = None, entities
    for attempt in range(rounds):
        named = todo.select("kind", "canonical", "form").withColumn("surrogate", surrogate(F.col("kind"), F.col("canonical"), F.lit(attempt), key, F.col("form")))
        taken = entities.select("kind", F.col("canonical").alias("surrogate"))
        if done is not None:
            taken = taken.unionByName(done.select("kind", "surrogate"))
        first = named.groupBy("kind", "surrogate").agg(F.min("canonical").alias("first"))
        free = first.join(taken, ["kind", "surrogate"], "left_anti").select("kind", "surrogate", F.col("first").alias("canonical"), F.lit(True).alias("ok"))
        judged = written(named.join(free, ["kind", "canonical", "surrogate"], "left"), "surrogates")
        good = judged.where("ok").select("kind", "canonical", "surrogate")
        done = good if done is None else done.unionByName(good)
        todo = judged.where("ok is null")
        if todo.isEmpty():
            return done
    raise ValueError(f"no distinct surrogates for all entities within {rounds} rounds: some format is too small for what the corpus holds of it")


def _pour(match: Column, digits: Column) -> Column:
    """The match with its digits, in order, replaced by these."""
    return F.array_join(
        F.transform(F.split(match, ""), lambda c, i: F.when(c.rlike(r"\d"), F.substr(digits, F.char_length(F.regexp_replace(F.substr(match, F.lit(1), i + 1), r"\D", "")), F.lit(1))).otherwise(c)), ""
    )


def _spaced_like(match: Column, packed: Column) -> Column:
    """The characters of packed, with blanks where the match has them."""
    return F.array_join(F.transform(F.split(match, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substr(packed, F.char_length(F.replace(F.substr(match, F.lit(1), i + 1), F.lit(" "))), F.lit(1)))), "")


def _cased_like(word: Column, name: Column) -> Column:
    """The name in the capitals of the word."""
    return F.when(word == F.lower(word), name).when((word == F.upper(word)) & (F.char_length(word) > 1), F.upper(name)).otherwise(F.initcap(name))


def _rewritten(match: Column, kind: Column, found: Column) -> Column:
    """The match with the surrogates of its entities (array<string>, in order) in its own format."""
    first = F.get(found, F.lit(0))
    before = F.regexp_extract(match, _BEFORE_NAME, 1)

    def titled(words: Column) -> Column:
        is_name = lambda w: w.rlike(r"^\p{Lu}")
        rank = lambda i: F.size(F.filter(F.slice(words, F.lit(1), i + 1), is_name)) - 1
        return F.concat(before, F.array_join(F.transform(words, lambda w, i: F.when(is_name(w), _cased_like(w, F.get(found, rank(i)))).otherwise(w)), " "))

    value = F.when(match.startswith("AKIA"), first).otherwise(F.concat(F.regexp_extract(match, r"""(?s)^(.*?[=:]\s{0,2}["']?)[^\s"']+$""", 1), first))
    shouted = F.when(match == F.upper(match), F.upper(first)).otherwise(first)
    return (
        F.when(kind == "person", let(F.split(F.regexp_replace(match, _BEFORE_NAME, ""), " "), titled)).when(kind.isin("phone", "card", "ssn"), _pour(match, first)).when(kind == "secret", value)
        .when(kind == "iban", _spaced_like(match, first)).when(kind.isin("email", "ipv6"), shouted).otherwise(first)
    )


def matches(text: Column) -> Column:
    """Everything in the text that ANY fits, in order."""
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def case_counts(docs: DataFrame, words: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (canonical, low, cap) for words (canonical): in how many texts each stands in lower case, and with capitals.

    A text counts once for each spelling. Words that no text has as a run of letters have no row.
    """
    forms = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(r"\p{L}+"), F.lit(0)))).alias("w"))
    counted = forms.select(F.lower("w").alias("canonical"), (F.col("w") == F.lower("w")).alias("is_low")).join(words.select("canonical").distinct(), "canonical")
    return counted.groupBy("canonical").agg(F.count_if("is_low").alias("low"), F.count_if(~F.col("is_low")).alias("cap"))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, match, kind), one per occurrence. Null texts have none."""
    found = docs.select(id_col, F.explode(matches(F.col(text_col))).alias("match"))
    return found.withColumn("kind", kind_of(F.col("match"))).where("kind is not null")


def pseudonymise(docs: DataFrame, key: str = DEFAULT_KEY, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """docs with text rewritten, n_entities (int) and entity_kinds (sorted array<string>, empty where nothing was found).

    No row is dropped; null texts stay null; texts without entities are unchanged. Rows equal in id and
    text get equal results. Columns of the result's names are replaced.

    Distinct matches are few beside texts: they alone are classified, named and checked for collisions.
    Their surrogates go back by match, pre-aggregated to one row for each document and match, then to
    one row for each document, which is as large as what that document holds; a match that very many
    documents share is split by the planner, as both sides of that join are tables. Where persons were found
    texts are read once more, to count how their words are written.
    """
    k, v, t = F.col(id_col).alias("k"), F.xxhash64(text_col).alias("v"), F.col(text_col)
    held = written(docs.select(k, v, F.array_distinct(matches(t)).alias("ms")).where("size(ms) > 0").distinct(), "matches")
    by_doc = held.select("k", "v", F.explode("ms").alias("match"))
    kinds = by_doc.select("match").distinct().withColumn("kind", kind_of(F.col("match"))).where("kind is not null")
    parts = kinds.select("match", "kind", F.posexplode(entities_of(F.col("match"), F.col("kind"))).alias("pos", "e"))
    parts = written(parts.select("match", F.col("kind").alias("of"), "pos", "e.*", ((F.col("kind") != "person") | F.col("match").rlike(_SURE)).alias("sure")), "parts")
    people = parts.where("of = 'person'")
    if people.isEmpty():
        case = people.select("canonical", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("cap"))
    else:
        case = written(case_counts(docs, people, text_col), "cases")
        # Weak evidence is refused if one of its words is in lower case at least as often.
        weak = people.where("not sure").join(case, "canonical", "left").groupBy("match").agg(F.bool_or(F.coalesce("low", F.lit(0)) >= F.greatest(F.coalesce("cap", F.lit(0)), F.lit(1))).alias("refused"))
        parts = written(parts.join(weak.where("refused"), "match", "left_anti"), "parts")
    most = F.when(F.count_if(F.col("gender") == "m") > F.count_if(F.col("gender") == "f"), "m").when(F.count_if(F.col("gender") == "f") > F.count_if(F.col("gender") == "m"), "f").otherwise("u")
    forms = parts.groupBy("kind", "canonical").agg(F.concat(F.when(2 * F.count_if("given") > F.count(F.lit(1)), "given_").otherwise("surname_"), most).alias("form"))
    names = assign(forms, key, rounds)
    cased = parts.join(names, ["kind", "canonical"]).join(case, "canonical", "left").withColumns({"low": F.coalesce("low", F.lit(0)), "cap": F.coalesce("cap", F.lit(0))})
    named = cased.groupBy("match", "of").agg(F.array_sort(F.collect_list(F.struct("pos", "surrogate", "canonical", "low", "cap"))).alias("found"))
    new = _rewritten(F.col("match"), F.col("of"), F.transform("found", lambda x: x["surrogate"]))
    # Words in lower case more often than not never go by themselves, others in lower case only if that is rare.
    in_any_case = lambda x: (2 * x["low"] <= x["cap"]) & (F.char_length(x["canonical"]) >= SHORT_NAME) | (x["cap"] == 0)
    words = F.transform(F.filter("found", lambda x: x["low"] <= x["cap"]), lambda x: F.struct(x["canonical"].alias("word"), x["surrogate"].alias("surrogate"), in_any_case(x).alias("any_case")))
    alone = F.when(F.col("of") == "person", words).otherwise(F.array())
    rewritten = written(named.select("match", "of", new.alias("new"), alone.alias("names")), "replacements")
    maps = by_doc.join(rewritten, "match").groupBy("k", "v").agg(F.collect_list(F.struct("match", F.struct("new", "of"))).alias("pairs"), F.flatten(F.collect_list("names")).alias("names"))

    kept = [c for c in docs.columns if c not in ("n_entities", "entity_kinds")]
    c_k, c_v, c_map, c_names, c_new = unused(docs, "k", "v", "map", "names", "new")
    maps = maps.select(F.col("k").alias(c_k), F.col("v").alias(c_v), F.map_from_entries("pairs").alias(c_map), F.array_sort(F.array_distinct("names")).alias(c_names))
    joined = docs.select(*kept).join(maps, F.col(id_col).eqNullSafe(F.col(c_k)) & (F.xxhash64(text_col) == F.col(c_v)), "left")
    # Names are looked for between the matches of ANY, whose pattern is one for all texts.
    pattern = F.concat(F.lit(r"(?<!\p{L})(?iu:"), F.array_join(F.transform(c_names, lambda n: n["word"]), "|"), F.lit(r")(?!\p{L})"))

    def swapped(m: Column) -> Column:
        def by(n: Column) -> Column:
            gone = n.isNotNull() & (n["any_case"] | (m != F.lower(m)))
            return F.struct(F.when(gone, _cased_like(m, n["surrogate"])).otherwise(m).alias("new"), F.coalesce(gone, F.lit(False)).cast("int").alias("n"))

        return let(F.get(F.filter(c_names, lambda n: n["word"] == F.lower(m)), F.lit(0)), by)

    def put_together(gaps: Column, between: Column) -> Column:
        return F.array_join(F.zip_with(gaps, between, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")

    def bare(gap: Column) -> Column:
        """struct<text, kinds>: the gap with its names replaced."""
        def of(found: Column) -> Column:
            n = F.aggregate(found, F.lit(0), lambda a, x: a + x["n"])
            return F.struct(put_together(F.split(gap, pattern, -1), F.transform(found, lambda x: x["new"])).alias("text"), F.array_repeat(F.lit("person"), n).alias("kinds"))

        as_it_is = F.struct(gap.alias("text"), F.array().cast("array<string>").alias("kinds"))
        return F.when(F.size(c_names) > 0, let(F.transform(F.regexp_extract_all(gap, pattern, F.lit(0)), swapped), of)).otherwise(as_it_is)

    known = lambda m: let(F.col(c_map)[m], lambda x: F.coalesce(F.when(x.isNotNull(), F.struct(x["new"].alias("text"), F.array(x["of"]).alias("kinds"))), bare(m)))
    new = let(
        F.struct(F.transform(F.split(t, ANY, -1), bare).alias("gaps"), F.transform(matches(t), known).alias("found")),
        lambda s: F.struct(put_together(s["gaps"]["text"], s["found"]["text"]).alias("text"), F.concat(F.flatten(s["gaps"]["kinds"]), F.flatten(s["found"]["kinds"])).alias("kinds")),
    )
    done = joined.withColumn(c_new, F.when(F.col(c_map).isNotNull(), new))
    kinds_of = F.coalesce(F.col(c_new)["kinds"], F.array().cast("array<string>"))
    return done.withColumns({
        text_col: F.coalesce(F.col(c_new)["text"], t), "n_entities": F.size(kinds_of), "entity_kinds": F.array_sort(F.array_distinct(kinds_of)),
    }).select(*kept, "n_entities", "entity_kinds")
