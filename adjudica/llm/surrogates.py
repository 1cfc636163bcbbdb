"""Personal data replaced by keyed surrogates of the same type, gender, script and format."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adjudica.llm.columns import row_key
from adjudica.llm.given_names import DETECTED
from adjudica.session import materialize

# Given names by script and gender, forms of address, and syllables of surnames.
GIVEN = {
    ("latin", "f"): "Anna Maria Laura Julia Clara Sofia Emma Marie Sarah Elena Lucia Carmen Alice Ines "
    "Nadia Helen Ruth Paula Irene Eva Mary Linda Susan Karen Emily",
    ("latin", "m"): "James John Robert Michael David Thomas Peter Paul Martin Lukas Felix Hugo Louis "
    "Pierre Jean Carlos Miguel Pablo Jorge Hans Karl Otto William Daniel Simon",
    ("cyrillic", "f"): "Анна Мария Елена Ольга Ирина Наталья Светлана Татьяна Юлия Вера",
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил Павел Борис",
}
TITLES = {
    "m": "Mr|Herrn?|Monsieur|Señor|Sr|Signor|господин|г-н",
    "f": "Mrs|Ms|Miss|Frau|Fräulein|Madame|Mme|Mlle|Mademoiselle|Señora|Señorita|Sra|Srta|Signora|Dra|Profesora|Doctora|госпожа|г-жа",
    "": "Dr|Prof|Professor|Professeur|Profesor|Doctor|Docteur|Doktor|Mx|профессор|доктор|д-р",
}
SYLLABLES = {
    "latin": "ba be bo da del do fen ga gor ha hil ka kel la len lo ma mer mi na nel no pa per ra rin "
    "ro sa sel so ta tor ul va ver vi wen za zel zo",
    "cyrillic": "ба бел бо да дер до га гор ка ков ла лен ло ма мер ми на нов по ра рин ро са сел со та",
}
#: Given names by gender: the detected ones and the surrogates, so that an output's names are found again.
_NAMES = {
    g: sorted({*DETECTED[g].split(), *(n for (_, a), names in GIVEN.items() if a == g for n in names.split())})
    for g in ("f", "m")
}


def _any_of(words: list[str]) -> str:
    """A pattern of whole words that looks at the rest of a word only behind its first letter."""
    tails = {}
    for word in sorted(set(words), reverse=True):
        tails.setdefault(word[0], []).append(word[1:])
    return "(?:" + "|".join(f"{c}(?:{'|'.join(t)})" for c, t in sorted(tails.items())) + r")(?!\p{L})"


_ANY_TITLE = r"(?:(?:" + "|".join(TITLES.values()) + r")\.? ){1,3}"
_ONE_NAME = r"\p{Lu}\p{L}+(?:-\p{Lu}\p{L}+){0,20}"
_SURNAME = r"(?:\p{Lu}['’])?" + _ONE_NAME
_LABEL = r"(?i:token|secret|password|passwd|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
_HEX = r"(?=[0-9A-Fa-f]{32})(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])"
#: One more digit, which may stand behind separators; a group such as 030 behind one starts another number.
_MORE = r"(?:[ .()/-]{1,3}(?!0\d\d)\d|\d)"
#: Kinds of personal data and how they look. Order matters: the first that fits a place wins.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++){1,126}",
    "secret": r"(?=[A-Za-z])(?<![\p{L}\p{N}])" + _LABEL + r"[^\s\"']{7,}[^\s\"'.,;:)\]}>]|" + _HEX,
    "ip": r"(?=\d)(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "ssn": r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?=\+)(?<![\d+])\+\d(?:[ .()/-]{0,3}\d){6}" + _MORE + r"{0,8}(?!\d)"
    r"|(?=\()(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?=\d)(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])"
    r"|(?=\(?0)(?<![\p{L}\d.,:/+-])(?!\d\d([./-])\d\d\1\d{4}(?!\d))\(?0\d(?:[ .()/-]{0,3}\d){6}" + _MORE + r"{0,7}(?!\d)",
    "card": r"(?=\d)(?<![0-9A-Za-z])\d(?:[ -]?\d){12,18}(?![0-9A-Za-z])",
    "name": r"(?=[\p{Lu}гпд])(?<![\p{L}\p{N}])(?:" + _ANY_TITLE + "(?:" + _ONE_NAME + " )?" + _SURNAME
    + r"|(?=\p{Lu}[\p{L}-]{1,200} \p{Lu})(?:" + _any_of(_NAMES["f"] + _NAMES["m"]) + r"(?:-\p{Lu}\p{L}+)? ){1,3}" + _SURNAME + ")",
}
#: Characters of which every kind but names holds at least one; most texts hold none.
TELLTALE = "[0-9@=:]"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_TITLE = "^" + _ANY_TITLE
#: Draws in the format of the value; numbers and addresses still open then get the free values left.
ROUNDS = 12
#: Kinds whose format fixes the length, so that their values can be listed.
LISTED = ("ssn", "phone", "card", "ip")
#: Rows that one task ranks.
RANKED_ROWS = 100_000


def _starts(kind: str) -> str:
    return "^(?:" + PATTERNS[kind] + ")$"


def kind_of(value: Column) -> Column:
    chosen = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        chosen = F.when(value.rlike(_starts(kind)), kind).otherwise(chosen)
    return chosen


def _core(kind: Column, value: Column) -> Column:
    """What identifies the entity, however it is written."""
    digits = F.regexp_replace(value, r"\D", "")
    secret = F.regexp_replace(value, "^" + _LABEL, "")
    return (
        F.when(kind == "email", F.lower(value))
        .when(kind == "secret", F.when(secret.rlike("^[0-9A-Fa-f]+$"), F.lower(secret)).otherwise(secret))
        .when(kind == "ip", value)
        .when(kind == "name", F.lower(F.regexp_replace(value, _TITLE, "")))
        .otherwise(digits)
    )


def _gender(kind: Column, value: Column) -> Column:
    """By the form of address, else by the given name; m where neither tells."""
    bare = F.regexp_replace(value, _TITLE, "")
    titled = {g: value.rlike(r"^(?:\S+ ){0,2}(?:" + TITLES[g] + r")\.? ") for g in ("f", "m")}
    female = F.when(titled["f"], True).when(titled["m"], False).otherwise(bare.rlike("^" + _any_of(_NAMES["f"])))
    return F.when(kind == "name", F.when(female, "f").otherwise("m")).otherwise("")


def _byte(digest: Column, at: Column | int) -> Column:
    """A number of 0 to 255 from the hexadecimal digest; places beyond it start over, shifted."""
    at = F.lit(at) if isinstance(at, int) else at
    code = F.substr(digest, (at % 64) * 2 + 1, F.lit(2))
    return F.conv(code, 16, 10).cast("int") + 7 * F.floor(at / 64).cast("int")


def _pick(choices: str, digest: Column, at: int) -> Column:
    options = choices.split()
    number = _byte(digest, at) * 256 + _byte(digest, at + 1)
    return F.element_at(F.array(*[F.lit(o) for o in options]), (number % len(options) + 1).cast("int"))


def _replace_characters(value: Column, digest: Column, letters: str) -> Column:
    """Digits become digits, letters become one of ``letters``, everything else stays."""
    return F.array_join(
        F.transform(
            F.split(value, ""),
            lambda c, i: F.when(
                c.rlike(r"^\d$"), F.substr(F.lit("0123456789"), _byte(digest, i) % 10 + 1, F.lit(1))
            )
            .when(
                c.rlike(r"^\p{L}$"),
                F.substr(F.lit(letters), _byte(digest, i) % len(letters) + 1, F.lit(1)),
            )
            .otherwise(c),
        ),
        "",
    )


def _luhn(digits: Column) -> Column:
    """The checksum of a row of digits; 0 for valid card numbers."""
    backwards = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    doubled = F.transform(
        backwards, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    )
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10


def _numbers(core: Column, kind: Column, digest: Column) -> Column:
    """As many digits, the first one kept; valid card numbers stay valid."""
    rest = _replace_characters(F.substr(core, F.lit(2)), digest, "x")
    drawn = F.concat(F.substr(core, F.lit(1), F.lit(1)), rest)
    body = F.substr(drawn, F.lit(1), F.length(drawn) - 1)
    check = (10 - _luhn(F.concat(body, F.lit("0")))) % 10
    valid = (kind == "card") & (_luhn(core) == 0)
    return F.when(valid, F.concat(body, check.cast("string"))).otherwise(drawn)


def _email(core: Column, digest: Column, domain_digest: Column, longer: Column) -> Column:
    local = F.substring_index(core, "@", 1)
    ending = F.regexp_extract(core, r"\.(com|org|net)$", 1)
    host = F.array_join(
        F.transform(
            F.sequence(F.lit(0), F.lit(7)),
            lambda i: F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), _byte(domain_digest, i) % 26 + 1, F.lit(1)),
        ),
        "",
    )
    return F.concat(
        _replace_characters(local, digest, "abcdefghijklmnopqrstuvwxyz"), longer,
        F.lit("@"), host, F.lit(".example."), F.when(ending == "", "org").otherwise(ending),
    )


def _syllables(script: str, digest: Column, n: int, first: int = 4) -> list[Column]:
    return [_pick(SYLLABLES[script], digest, first + 2 * i) for i in range(n)]


def _given(gender: Column, script: Column, digest: Column, longer: int) -> Column:
    chosen = None
    for (a_script, a_gender), names in GIVEN.items():
        made = F.concat(*_syllables(a_script, digest, longer), _pick(names, digest, 0))
        hit = (script == a_script) & (gender == a_gender)
        chosen = F.when(hit, made) if chosen is None else chosen.when(hit, made)
    return chosen


def _surname(script: Column, digest: Column, longer: int) -> Column:
    latin, cyrillic = (
        F.concat(*_syllables(a_script, digest, 3 + longer)) for a_script in ("latin", "cyrillic")
    )
    return F.when(script == "latin", latin).otherwise(cyrillic)


def _last(core: Column) -> Column:
    return F.substring_index(core, " ", -1)


def surrogate(frame: DataFrame, key: str, attempt: int) -> Column:
    """The surrogate core of an entity row (kind, core, gender, script) at one attempt.

    A full name keeps its real surname here; ``entity_surrogates`` puts the mapped one in its place.
    The space grows with the attempt: names by syllables, e-mail addresses and secrets by characters,
    and after ``ROUNDS`` numbers by digits and addresses by octets over 255.
    """
    longer = min(attempt // 4, 20)
    beyond = max(attempt - ROUNDS + 1, 0)
    kind, core = F.col("kind"), F.col("core")
    drawn = F.sha2(F.concat_ws("|", F.lit(key), F.lit(str(attempt)), kind, "gender", core), 512)
    # Bound by a lambda, so that a long entity is hashed once and not once for each of its characters.
    made = F.transform(F.array(drawn), lambda digest: _drawn(digest, key, longer, beyond))
    return F.element_at(made, 1)


def _drawn(digest: Column, key: str, longer: int, beyond: int) -> Column:
    """The surrogate that ``digest`` stands for; the space is ``longer`` and ``beyond`` as wide."""
    kind, core = F.col("kind"), F.col("core")
    domain = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), F.substring_index(core, "@", -1)), 512)
    more = F.sha2(F.concat(digest, F.lit("more")), 512)
    tail, digits = F.substr(more, F.lit(1), F.lit(longer)), F.translate(more, "abcdef", "012345")
    octet = (lambda k: _byte(digest, k) % 254 + 1) if not beyond else (
        lambda k: (_byte(digest, 2 * k) * 256 + _byte(digest, 2 * k + 1)) % 744 + 256
    )
    octets = F.concat_ws(".", *[octet(k).cast("string") for k in range(4)])
    is_hex = core.rlike("^[0-9a-f]+$")
    return (
        F.when(kind == "email", _email(core, digest, domain, tail))
        .when(
            kind == "secret",
            F.concat(
                F.when(is_hex, _replace_characters(core, digest, "abcdef")).otherwise(
                    _replace_characters(core, digest, "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ")
                ),
                tail,
            ),
        )
        .when(kind == "ip", octets)
        .when(kind == "surname", _surname(F.col("script"), digest, longer))
        .when(
            kind == "name",
            F.concat_ws(" ", F.lower(_given(F.col("gender"), F.col("script"), digest, longer)), _last(core)),
        )
        .otherwise(F.concat(_numbers(core, kind, digest), F.substr(digits, F.lit(1), F.lit(beyond))))
    )


def _ranked(frame: DataFrame, by: Column) -> DataFrame:
    """``frame`` with ``rank`` 1, 2, … over all rows, counted in parts of about ``RANKED_ROWS``."""
    parts = frame.count() // RANKED_ROWS + 1
    table = frame.withColumn("by", by).withColumn("part", F.pmod(F.xxhash64("by"), F.lit(parts)))
    before, starts = 0, []
    for part, n in sorted(table.groupBy("part").count().collect()):
        starts.append((part, before))
        before += n
    starts = frame.sparkSession.createDataFrame(starts, "part long, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy("by"))
    table = table.withColumn("place", place).join(F.broadcast(starts), "part")
    return table.withColumn("rank", F.col("before") + F.col("place")).drop("by", "part", "before", "place")


def _values(frame: DataFrame, kind: str, length: int, first: str | None, valid: bool) -> DataFrame:
    """Every value of a format; 12 draws leave entities open only where these are hardly more than they."""
    spark = frame.sparkSession
    if kind == "ip":
        at = spark.range(254**4)
        octets = [F.expr(f"cast(id div {254**k} % 254 + 1 as string)") for k in (3, 2, 1, 0)]
        return at.select(F.concat_ws(".", *octets).alias("surrogate"))
    width = length - (first is not None) - valid
    body = F.lpad(F.col("id").cast("string"), width, "0") if width else F.lit("")
    body = F.concat(F.lit(first or ""), body)
    made = spark.range(10**width).select(body.alias("body"))
    check = ((10 - _luhn(F.concat("body", F.lit("0")))) % 10).cast("string")
    return made.select((F.concat("body", check) if valid else F.col("body")).alias("surrogate"))


def _free_values(open_ones: DataFrame, taken: DataFrame, key: str, keep_first: bool) -> DataFrame | None:
    """(kind, core, surrogate): open numbers and addresses joined with free values of their format by rank."""
    first = F.substr("core", F.lit(1), F.lit(1)) if keep_first else F.lit(None).cast("string")
    ip, card = F.col("kind") == "ip", F.col("kind") == "card"
    formats = open_ones.where(F.col("kind").isin(*LISTED)).select(
        "kind", "core",
        F.when(ip, 0).otherwise(F.length("core")).alias("length"),
        F.when(~ip, first).alias("first"),
        F.when(card, _luhn(F.col("core")) == 0).otherwise(False).alias("valid"),
    )
    found = None
    for kind, length, digit, valid in formats.select("kind", "length", "first", "valid").distinct().collect():
        same = (F.col("kind") == kind) & (F.col("length") == length) & (F.col("valid") == valid)
        waiting = formats.where(same & F.col("first").eqNullSafe(F.lit(digit))).select("kind", "core")
        used = taken.where(F.col("kind") == kind).select("surrogate")
        free = _values(open_ones, kind, length, digit, valid).join(used, "surrogate", "left_anti")
        free = _ranked(materialize(free, "free-values"), F.sha2(F.concat(F.lit(key + "|"), "surrogate"), 256))
        given = _ranked(waiting, F.col("core")).join(free, "rank").select("kind", "core", "surrogate")
        # Stored at once: values of the next format must not meet these.
        given = materialize(given, "surrogates")
        taken = taken.union(given.select("kind", "surrogate"))
        found = given if found is None else found.union(given)
    return found


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """(kind, core, surrogate): different entities of a kind get different surrogates, none of which is
    an entity of the table.

    Each round draws one surrogate per open entity. The smallest entity of those that drew the same
    keeps it, unless it is taken or real; the others draw again with the next attempt. Numbers and
    addresses that are open after ``ROUNDS`` get the free values of their length, first with their own
    first digit, then with any. Where no value of the length is free, the surrogate of a number is
    longer and that of an address has octets over 255, so that neither can be real.
    """
    real = materialize(entities.distinct(), "entities")
    open_ones, settled = real, None
    taken = real.select("kind", F.col("core").alias("surrogate"))

    def settle(good: DataFrame) -> None:
        nonlocal open_ones, settled, taken
        settled = good if settled is None else settled.union(good)
        taken = taken.union(good.select("kind", "surrogate"))
        open_ones = materialize(open_ones.join(good, ["kind", "core"], "left_anti"), "open-entities")

    for attempt in itertools.count():
        if attempt == ROUNDS:
            for keep_first in (True, False):
                found = _free_values(open_ones, taken, key, keep_first)
                if found is not None:
                    settle(found)
        drawn = open_ones.select("kind", "core", surrogate(open_ones, key, attempt).alias("surrogate"))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("core").alias("core"))
        good = first.join(taken, ["kind", "surrogate"], "left_anti").select("kind", "core", "surrogate")
        settle(materialize(good, "surrogates"))
        if open_ones.isEmpty():
            return settled


def _with_surnames(entities: DataFrame) -> DataFrame:
    """Surnames as entities of their own; of the names only those with a given name stay."""
    surname = _last(F.col("core"))
    script = F.when(surname.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    surnames = entities.where("kind = 'name'").select(
        F.lit("surname").alias("kind"), surname.alias("core"), F.lit("").alias("gender"), script.alias("script")
    )
    rest = entities.where((F.col("kind") != "name") | F.col("core").contains(" "))
    return rest.select("kind", "core", "gender", "script").union(surnames.distinct())


def entity_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, core, surrogate) where a name is a given name's surrogate and the surname's, or the surname's.

    A surname has one surrogate wherever it stands, and no two surnames share one. Full names with the
    same surname get different given names.
    """
    table = surrogate_table(_with_surnames(entities), key)
    surnames = table.where("kind = 'surname'").select(
        F.col("core").alias("surname"), F.col("surrogate").alias("mapped")
    )
    alone = surnames.select(F.lit("name").alias("kind"), F.col("surname").alias("core"), F.col("mapped").alias("surrogate"))
    full = table.where("kind = 'name'").withColumn("surname", _last(F.col("core"))).join(surnames, "surname")
    full = full.select("kind", "core", F.concat_ws(" ", F.substring_index("surrogate", " ", 1), F.col("mapped")).alias("surrogate"))
    return table.where("kind not in ('name', 'surname')").union(full).union(alone)


def _written(kind: Column, value: Column, made: Column) -> Column:
    """The surrogate core in the format of one occurrence."""
    digits = F.array_join(
        F.transform(
            F.split(value, ""),
            lambda c, i: F.when(
                c.rlike(r"^\d$"),
                F.substr(
                    made, F.length(F.regexp_replace(F.substr(value, F.lit(1), i + 1), r"\D", "")), F.lit(1)
                ),
            ).otherwise(c),
        ),
        "",
    )
    length = F.length(F.regexp_replace(value, r"\D", ""))
    digits = F.concat(digits, F.substr(made, length + 1, F.length(made)))
    shouted = (F.upper(value) == value) & (F.lower(value) != value)
    secret = F.regexp_replace(value, "^" + _LABEL, "")
    before_secret = F.regexp_extract(value, "^(" + _LABEL + ")", 1)
    loud = (F.upper(secret) == secret) & secret.rlike("^[0-9A-F]+$")
    title = F.regexp_extract(value, "(" + _TITLE + ")", 1)
    full = F.initcap(made)
    return (
        F.when(kind == "email", F.when(shouted, F.upper(made)).otherwise(made))
        .when(kind == "secret", F.concat(before_secret, F.when(loud, F.upper(made)).otherwise(made)))
        .when(kind == "ip", made)
        .when(kind == "name", F.concat(title, F.when(shouted, F.upper(full)).otherwise(full)))
        .otherwise(digits)
    )


def replace_personal_data(
    docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(row, text, n_entities, kinds) of every row; ``row`` holds all columns of ``docs`` as they were.

    Detected are e-mail addresses, secrets, IP addresses, social security, phone and card numbers, and
    names behind a form of address or a known given name. Phone numbers have a country prefix or a leading
    0 and then 7 to 14 digits in any grouping, or ten digits in the American one; a labelled secret runs to
    white space or a quote, less closing punctuation. Equal entities get equal surrogates in the
    whole table, also where they are written differently (coreference); different ones get different
    surrogates (checked by ``surrogate_table``). Only someone with ``key`` can repeat the mapping.

    Null text stays null with no entities, texts without entities stay as they are, null ids and
    repeated rows are handled like others, an empty table gives no row. Only texts with entities move,
    once; the rest of the data in motion are the entities. Built-in functions only.
    """
    own = docs.select(
        F.struct("*").alias("row"), F.col(doc_id).alias("own_id"), F.col(text).alias("own_text")
    )
    # The two cheap patterns spare most texts the search for everything.
    likely = F.col("own_text").rlike(TELLTALE) & F.col("own_text").rlike(ANY)
    has = F.coalesce(F.col("own_text").rlike(PATTERNS["name"]) | likely, F.lit(False))
    plain = own.where(~has).select(
        "row", F.col("own_text").alias("text"), F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("kinds")
    )
    keyed = own.where(has).withColumn("key", row_key(F.col("own_id"), F.col("own_text")))
    found = keyed.select("key", F.posexplode(F.regexp_extract_all("own_text", F.lit(ANY), F.lit(0))).alias("at", "value"))
    found = found.select("key", "at", "value", kind_of(F.col("value")).alias("kind"))
    core = _core(F.col("kind"), F.col("value"))
    found = found.select(
        "key", "at", "value", "kind", core.alias("core"), _gender(F.col("kind"), F.col("value")).alias("gender"),
        F.when(F.col("value").rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin").alias("script"),
    )
    found = materialize(found, "entity-places")
    entities = found.groupBy("kind", "core").agg(F.min("gender").alias("gender"), F.min("script").alias("script"))
    table = entity_surrogates(entities, key)
    written = found.join(table, ["kind", "core"]).select(
        "key", "at", "kind", _written(F.col("kind"), F.col("value"), F.col("surrogate")).alias("new")
    )
    # Repeated rows have one key; their equal places count once.
    written = written.groupBy("key", "at").agg(F.min("kind").alias("kind"), F.min("new").alias("new"))
    lists = written.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("at", "new"))).alias("places"),
        F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"),
    )
    pieces = F.split("own_text", ANY, -1)
    new = F.concat(F.transform("places", lambda p: p["new"]), F.array(F.lit("")))
    changed = keyed.join(lists, "key").select(
        "row",
        F.array_join(F.zip_with(pieces, new, lambda a, b: F.concat(a, b)), "").alias("text"),
        F.size("places").cast("long").alias("n_entities"),
        "kinds",
    )
    return plain.union(changed)
