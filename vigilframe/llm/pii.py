"""Surrogates for personal data, with DataFrame functions only.

Mentions are found by one pattern; each gives an entity of a type in a normal form. Entities get
keyed candidates from SHA-256 of (key, type, normal form, attempt), consistent in type, format, script
and gender; a candidate that equals another entity's surrogate or a real entity is drawn again.
Equal entities get equal surrogates in all documents, a mail domain is one entity of all its addresses,
and in a document that names a person the bare given name or surname is that person's again, unless
it is a word of the calendar or the document has it in small letters too. Telephone numbers and IP
addresses become such as nobody has: unassigned area codes, reserved and documentation ranges.

Detected: mail addresses (local parts of at most 64 characters), IBANs, card numbers with a valid check
digit, social security numbers, IPv4 and IPv6 addresses, telephone numbers, keys after words like
`token =`, and names: after a title, or of a listed given name and a surname. A name without either
is not found. Every part of the pattern is bounded or possessive, so a text costs linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, durable

# Titles by gender, given names by script and gender, syllables by script.
TITLES = {
    "m": "Mr Herr Monsieur Señor Sir Signor Господин Κύριος".split(),
    "f": "Mrs Ms Miss Frau Madame Mademoiselle Señora Señorita Signora Madam Госпожа Κυρία".split(),
    "u": "Dr Prof Professor Doctor Doktor".split(),
}
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Thomas Daniel Paul Simon Peter Hans Jürgen Pierre Jean Carlos José Luis Miguel Marco Ivan Sergei Dmitri Alexei Nikolai Piotr Rajesh Amit Sanjay Vikram Mohammed Ahmed Ali Omar Yusuf Wei Hiroshi Kenji Lars Sven Giovanni Antonio Stefan Klaus Georg Andrew Richard Charles Joseph Kevin".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Susan Sarah Karen Anna Emma Laura Julia Sabine Claire Marie Carmen María Sofía Lucía Giulia Olga Natalia Svetlana Irina Tatiana Katarzyna Priya Anjali Sunita Fatima Aisha Leila Yuki Mei Ingrid Astrid Chiara Francesca Petra Monika Ursula Barbara Margaret Nancy Lisa Helen".split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Сергей Дмитрий Николай Михаил Андрей Павел Олег".split(),
    ("cyrillic", "f"): "Анна Мария Ольга Елена Наталья Ирина Татьяна Светлана Юлия Вера".split(),
    ("greek", "m"): "Γιώργος Γιάννης Κώστας Νίκος Δημήτρης Παναγιώτης Βασίλης Μιχάλης".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Βασιλική Σοφία Αναστασία Ιωάννα Δήμητρα".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do ka ke lo la ma me na no ra re ri sa so ta te va ve vi zo".split(),
    "cyrillic": "ба бе бо да де до ка ке ло ла ма ме на но ра ре ри са со та те ва ве ви зо".split(),
    "greek": "βα βε βο δα δε δο κα κε λο λα μα με να νο ρα ρε ρι σα σο τα τε φα φε φι ζο".split(),
}
# Small letters of each script, for characters exchanged one by one.
SMALL = {r"\p{IsCyrillic}": "абвгдежзийклмнопрстуфхцчшщыэюя", r"\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω", r"[^\x00-\x7F]": "àáâãäåæçèéêëìíîïñòóôõöøùúûüý"}
# Words of the calendar, which follow a name without being part of it and stay when a person has one as a name; endings of surnames with a gender.
CALENDAR = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December Januar Februar März Mai Juni Juli Oktober Dezember Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag".split()
ENDINGS = "ова ева ёва ина ская цкая ов ев ёв ин ский цкий ova eva skaya ov ev sky".split()
WORDS_OF_KEYS = "password passwd token secret api_key apikey".split()
#: Drawing again stops with an error after so many rounds; a format with room left needs a few.
ROUNDS = 100
#: Letters and digits that a key has at least; fewer are a mask like `********`.
LEAST_KEY = 6


def _any_of(words: list[str]) -> str:
    """A pattern of any of `words`, the longest first, told apart by the first letter."""
    by_first: dict[str, list[str]] = {}
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        by_first.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by_first.items()))


_TITLE = _any_of([t for ts in TITLES.values() for t in ts])
_GIVEN = _any_of([n for ns in GIVEN.values() for n in ns])
_NAME = r"\p{Lu}(?:['’]\p{Lu}|\p{Ll}{1,3}\p{Lu})?\p{Ll}++(?:['’-]\p{L}\p{Ll}++)?"
_NEXT = rf" (?!(?:{_any_of(CALENDAR)})(?![\p{{L}}\p{{N}}_])){_NAME}"
_HEX = "[0-9A-Fa-f]{1,4}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_WORD = r"[\p{L}\p{N}_]"
PATTERNS = {
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "iban": rf"[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?(?!{_WORD})",
    "card": rf"(?:\d{{4}}[ -]?){{3}}\d{{1,7}}(?!{_WORD})|3[47]\d{{2}}[ -]?\d{{6}}[ -]?\d{{5}}(?!{_WORD})",
    "ssn": rf"\d{{3}}-\d{{2}}-\d{{4}}(?!{_WORD})",
    "ip": rf"{_OCTET}(?:\.{_OCTET}){{3}}(?!{_WORD}|\.\d)",
    "ipv6": rf"(?:{_HEX}:){{7}}{_HEX}(?!{_WORD}|:)|(?=[A-Fa-f:]{{0,30}}[0-9])(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}(?!{_WORD}|:)",
    "phone": rf"(?:\+\d{{1,3}}[ .-]?)?(?:\(\d{{2,4}}\)[ .-]?|\d{{3}}[ .-])\d{{3}}[ .-]\d{{4}}(?!{_WORD})|\+\d{{1,3}}(?:[ .-]?\(?\d{{2,4}}\)?){{2,5}}(?!{_WORD})",
    "secret": rf"AKIA[0-9A-Z]{{16}}(?![0-9A-Z])|(?<=(?:{'|'.join(WORDS_OF_KEYS)}) {{0,2}}[=:] {{0,2}}[\"']?)[A-Za-z0-9_+/-]{{8,}}+",
    "name": rf"(?:{_TITLE})\.? {_NAME}(?:{_NEXT}){{0,2}}|(?:{_GIVEN}){_NEXT}",
}
#: One pattern for all types. It starts at the beginning of a word only.
MENTION = rf"(?<!{_WORD})(?<!\d\.)(?:{'|'.join(PATTERNS.values())})"


def _opening(words: list[str]) -> str:
    """A pattern of any of `words` and a blank or dot behind it: classes of the first two letters come first, which is quick."""
    pairs = sorted({w[:2] for w in words})
    rests = "|".join(rf"(?<={p})(?:{'|'.join(w[2:] for w in words if w[:2] == p)})" for p in pairs)
    one, two = ("".join(sorted({p[k] for p in pairs})) for k in (0, 1))
    return rf"[{one}][{two}](?<={'|'.join(pairs)})(?<!{_WORD}..)(?:{rests})[ .]"


_OPENINGS = [w for ws in (*TITLES.values(), *GIVEN.values()) for w in ws]
#: What any mention has in it: texts without are not looked at further.
TRIGGERS = [
    r"[0-9@]",
    rf"[=:](?<=(?:{'|'.join(WORDS_OF_KEYS)}) {{0,2}}[=:])",
    _opening([w for w in _OPENINGS if w[0] < "\u0370"]),
    rf"[\u0370-\u04FF](?<!{_WORD}.)(?:{_any_of([w[1:] for w in _OPENINGS if w[0] >= chr(0x370)])})[ .]",
]


def mentions(text: Column) -> Column:
    found = F.lit(False)
    for trigger in TRIGGERS:
        found = found | text.rlike(trigger)
    return F.when(found, F.regexp_extract_all(text, F.lit(MENTION), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _type(mention: Column) -> Column:
    return F.coalesce(*[F.when(mention.rlike(rf"^(?:{p})$"), F.lit(t)) for t, p in PATTERNS.items() if t != "secret"], F.lit("secret"))


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a string of digits."""
    return F.aggregate(
        F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("at")),
        lambda a, c: F.struct((a["sum"] + F.when(a["at"] % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) - F.when(c.cast("int") > 4, 9).otherwise(0))).alias("sum"), (a["at"] + 1).alias("at")),
        lambda a: a["sum"] % 10,
    )


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _byte(h: Column, i: Column) -> Column:
    """The i-th byte of a hex string of 64 bytes, taken in a circle."""
    return F.conv(F.substring(h, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _letters(value: Column, h: Column) -> Column:
    """Letters and digits exchanged for others of their kind, case and script (long hex stays hex); the rest stays."""
    pick = lambda base, n, i: F.char(F.lit(base) + _byte(h, i) % n)
    hexadecimal = value.rlike("^(?:[0-9a-f]{16,}|[0-9a-f:]*:[0-9a-f:]*)$")  # stays so

    def exchanged(c: Column, i: Column) -> Column:
        out = F.when(c.rlike("[0-9]"), pick(48, 10, i)).when(c.rlike("[a-z]"), pick(97, F.when(hexadecimal, 6).otherwise(26), i)).when(c.rlike("[A-Z]"), pick(65, 26, i))
        for kind, small in SMALL.items():
            letter = F.substring(F.lit(small), _byte(h, i) % len(small) + 1, F.lit(1))
            out = out.when(c.rlike(kind) & c.rlike(r"\p{L}"), F.when(c.rlike(r"\p{Lu}"), F.upper(letter)).otherwise(letter))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), exchanged), "")


def _draw(drawn: DataFrame, key: str) -> DataFrame:
    """Add `candidate`, the surrogate in normal form drawn for (type, norm, attempt); addresses get `host` as their domain.

    Built in steps, so that the hash and what derives from it are computed once a row.
    """
    norm, kind, attempt, h, digits, bank = (F.col(c) for c in ("norm", "type", "attempt", "_h", "_digits", "_bank"))
    size, script = F.length("norm"), F.col("_script")
    salted = lambda half: F.sha2(F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string"), F.lit(half)).cast("binary"), 256)
    steps = drawn.withColumn("_h", F.concat(salted("a"), salted("b"))).withColumn("_b", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: _byte(h, i)))
    byte = lambda i: F.get(F.col("_b"), i if isinstance(i, Column) else F.lit(i))
    steps = steps.withColumn("_digits", _letters(norm, h)).withColumn("_script", _script(norm))

    # names: a given name from the list of its script and gender, later attempts longer ones; syllables for surnames
    name = kind.startswith("given_") | (kind == "surname")
    count = F.when(kind == "surname", 2).otherwise(1) + F.floor(attempt / 2).cast("int")
    pool = lambda of: F.coalesce(*[F.when(script == s, F.array(*map(F.lit, of(s)))) for s in SYLLABLES])
    lists = [F.when(kind == f"given_{g}", pool(lambda s: GIVEN[s, g] if g != "u" else GIVEN[s, "m"] + GIVEN[s, "f"])) for g in "mfu"]  # noqa: B023
    steps = steps.withColumn("_given", F.coalesce(*lists)).withColumn("_parts", F.when(name, pool(lambda s: SYLLABLES[s])))
    pick = lambda i: F.get(F.col("_given"), byte(i) % F.size("_given"))
    made = F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), count), lambda i: F.get(F.col("_parts"), byte((i + 8) % 64) % F.size("_parts"))), ""))
    ending = F.when(kind == "surname", F.regexp_extract(norm, rf"\p{{L}}{{2}}({'|'.join(ENDINGS)})$", 1)).otherwise(F.lit(""))
    steps = steps.withColumn("_made", F.when(name, F.concat(made, ending)))
    # one name, two, and then one with made syllables: a list of names is soon used up
    given = F.when(attempt == 0, pick(0)).when(attempt == 1, F.concat_ws("-", pick(1), pick(2))).otherwise(F.concat_ws("-", pick(3), F.col("_made")))

    # numbers with check digits
    first = lambda text, least: F.char(F.lit(48 + least) + F.ascii(text) % (10 - least))
    body = F.concat(F.substring(norm, 1, 1), F.substring(digits, F.lit(2), size - 2))
    steps = steps.withColumn("_body", F.when(kind == "card", body)).withColumn("_valid", F.when(kind == "card", _luhn(norm) == 0)).withColumn("_check", F.when(kind == "card", (10 - _luhn(F.concat("_body", F.lit("0")))) % 10))
    card = F.concat("_body", F.when(F.col("_valid"), F.col("_check").cast("string")).otherwise(F.substring(digits, -1, 1)))
    moved = F.split(F.concat(F.substring(digits, F.lit(5), size), F.substring(norm, 1, 2), F.lit("00")), "")
    remainder = F.aggregate(moved, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    steps = steps.withColumn("_bank", F.when(kind == "iban", remainder))
    iban = F.concat(F.substring(norm, 1, 2), F.lpad((98 - bank).cast("string"), 2, "0"), F.substring(digits, F.lit(5), size))
    lead = F.greatest(size - 10, F.lit(0))
    # area codes with a 9 in the middle are held back for longer numbers: nobody has one
    area, rest = F.substring(digits, lead + 1, F.lit(3)), F.substring(digits, lead + 4, size)
    phone = F.when(size >= 10, F.concat(F.substring(norm, F.lit(1), lead), first(area, 2), F.lit("9"), F.substring(area, 3, 1), first(rest, 2), F.substring(rest, F.lit(2), size))).otherwise(
        F.concat(F.substring(norm, 1, 2), F.substring(digits, F.lit(3), size))
    )
    longer = F.when(attempt > 2, F.lower(F.substring(F.translate(F.base64(F.unhex(h)), "+/=", "xyz"), F.lit(1), attempt))).otherwise(F.lit(""))
    email = F.concat(F.substring_index(digits, "@", 1), longer, F.lit("@"), F.col("host"))
    domain = F.concat(F.substring_index(digits, ".", 1), longer, F.lit(".example."), F.get(F.array(*map(F.lit, ("com", "net", "org"))), byte(63) % 3))
    # private addresses stay in their block as long as there is room, others go to the reserved block from 240 on
    octet = [(F.lit(1) + byte(i) % 254).cast("string") for i in range(4)]
    blocks = {r"^10\.": ["10"], r"^127\.": ["127"], r"^192\.168\.": ["192", "168"], r"^169\.254\.": ["169", "254"]}
    ip = F.when(norm.rlike(r"^172\.(?:1[6-9]|2\d|3[01])\.") & (attempt < 20), F.concat_ws(".", F.lit("172"), (F.lit(16) + byte(1) % 16).cast("string"), *octet[2:]))
    for block, begin in blocks.items():
        ip = ip.when(norm.rlike(block) & ((attempt < 20) | (len(begin) == 1)), F.concat_ws(".", *map(F.lit, begin), *octet[len(begin) :]))
    ip = ip.when(norm.rlike(r"^(?:192\.168|172\.(?:1[6-9]|2\d|3[01])|169\.254)\."), F.concat_ws(".", F.lit("10"), *octet[1:])).otherwise(F.concat_ws(".", (F.lit(240) + byte(0) % 15).cast("string"), *octet[1:]))
    # the documentation prefix; short forms are soon used up and grow
    quads = [F.substring(F.lower(h), 4 * i + 1, 4) for i in range(4)]
    ipv6 = F.when(attempt > 2, F.concat(F.lit("2001:db8:"), quads[0], F.lit(":"), quads[1], F.lit("::"), quads[2])).otherwise(F.regexp_replace(digits, "^[0-9a-f]{1,4}(?::[0-9a-f]{1,4})?", "2001:db8"))
    mixed = F.concat(F.substring(F.translate(F.base64(F.unhex(h)), "+/=", "xyz"), F.lit(1), size), F.substring(digits, F.lit(89), size))
    secret = F.when(norm.rlike("^AKIA[0-9A-Z]{16}$"), F.concat(F.lit("AKIA"), F.substring(digits, 5, 16))).when(attempt > 9, mixed).otherwise(digits)
    ssn = F.concat(F.lit("9"), F.substring(digits, 2, 8))
    out = {"email": email, "domain": domain, "card": card, "ip": ip, "ipv6": ipv6, "phone": phone, "ssn": ssn, "iban": iban, "secret": secret, "surname": F.col("_made")}
    return steps.withColumn("candidate", F.coalesce(*[F.when(kind == t, c) for t, c in out.items()], given)).select(*drawn.columns, "candidate")


def _written(mention: Column, surrogate: Column) -> Column:
    """`surrogate`'s letters and digits in the places that letters and digits have in `mention`."""
    return F.aggregate(
        F.split(mention, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, c: F.when(c.rlike("[0-9A-Za-z]"), F.struct(F.concat(a["out"], F.substring(surrogate, a["at"] + 1, F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))),
        lambda a: a["out"],
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(type, norm, surrogate) for distinct (type, norm[, host]): distinct within a type, and no real entity of it.

    Rounds: every entity draws; of those that drew alike the one with the fewest attempts, then the
    least, keeps it; the others, and those that drew a real entity, draw again. Who keeps what is a
    minimum, which combines before the shuffle; nothing but the count of the losers goes to the driver.
    """
    kind = F.regexp_replace("type", "^given_.$", "given")
    host = F.col("host") if "host" in entities.columns else F.lit(None).cast("string")
    # drawing costs far more than a row's bytes tell, so the rows are dealt by count and not coalesced by size
    n = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    real = durable(entities.select("type", "norm", host.alias("host")).repartition(n, "type", "norm", "host").distinct())
    drawn = real.withColumns({"attempt": F.lit(0), "lost": F.lit(True), "surrogate": F.lit("")})
    taken = real.select(kind.alias("kind"), F.col("norm").alias("surrogate")).distinct().withColumn("hit", F.lit(True))
    for _ in range(ROUNDS):
        # those that keep theirs stay as they are; only losers draw
        fresh = durable(_draw(drawn.where("lost"), key).withColumn("surrogate", F.col("candidate")).drop("candidate"))
        tried = fresh.union(drawn.where("not lost")).withColumn("kind", kind)
        me = F.struct("attempt", "norm", "type")
        first = tried.groupBy("kind", "surrogate").agg(F.min(me).alias("first"))
        judged = tried.join(first, ["kind", "surrogate"]).join(taken, ["kind", "surrogate"], "left").withColumn("lost", (F.col("first") != me) | F.coalesce(F.col("hit"), F.lit(False)))
        drawn = durable(judged.select("type", "norm", "host", (F.col("attempt") + F.col("lost").cast("int")).alias("attempt"), "lost", "surrogate"))
        if drawn.where("lost").isEmpty():
            return drawn.select("type", "norm", "surrogate")
    raise ValueError(f"after {ROUNDS} rounds there are still equal surrogates: a format has too little room")


def mention_table(found: DataFrame, key: str) -> DataFrame:
    """(mention, type, surrogate, parts) for distinct mentions that are entities; `parts` are a name's [(norm, surrogate)]."""
    m = F.col("mention")
    digits = F.regexp_replace(m, "[^0-9]", "")
    typed = found.select("mention").distinct().withColumn("type", _type(m))
    # other long numbers are no cards, masks are no keys
    typed = durable(typed.where(((F.col("type") != "card") | (_luhn(digits) == 0)) & ((F.col("type") != "secret") | (F.length(F.regexp_replace(m, "[^0-9A-Za-z]", "")) >= LEAST_KEY))))
    norm = F.when(F.col("type").isin("email", "ipv6"), F.lower(m)).when(F.col("type").isin("card", "phone", "ssn"), digits).when(F.col("type") == "iban", F.regexp_replace(m, " ", "")).otherwise(m)
    plain = typed.where("type <> 'name'").withColumn("norm", norm).withColumn("domain", F.when(F.col("type") == "email", F.substring_index("norm", "@", -1)))

    titled = rf"^(?:{_TITLE})\.? "
    gender = F.coalesce(*[F.when(m.rlike(rf"^(?:{'|'.join(ts)})\.? "), F.lit(g)) for g, ts in TITLES.items() if g != "u"], F.lit("u"))
    words = F.split(F.regexp_replace(m, titled, ""), " ")
    by_list = lambda w: F.coalesce(*[F.when(w.isin([n for (_, x), ns in GIVEN.items() if x == g for n in ns]), F.lit(g)) for g in "mf"])
    kinds = F.transform(words, lambda w, i: F.struct((i + 1).alias("at"), F.when((i < F.size(words) - 1) | (by_list(w).isNotNull() & (F.size(words) > 1)), F.coalesce(by_list(w), gender)).alias("gender"), w.alias("norm")))
    names = typed.where("type = 'name'").select("mention", F.regexp_extract(m, titled, 0).alias("title"), F.explode(kinds).alias("x")).select("mention", "title", "x.*")
    # a given name has one gender: that of all its titles, or none if they differ
    genders = names.where("gender is not null").groupBy("norm").agg(F.max(F.col("gender") == "m").alias("m"), F.max(F.col("gender") == "f").alias("f"))
    one = F.when(F.col("m") & ~F.col("f"), "given_m").when(F.col("f") & ~F.col("m"), "given_f").otherwise("given_u")
    names = durable(names.join(genders, "norm", "left").select("mention", "title", "at", "norm", F.when(F.col("gender").isNull(), "surname").otherwise(one).alias("type")))

    domains = surrogates(plain.where("domain is not null").select(F.lit("domain").alias("type"), F.col("domain").alias("norm")), key)
    plain = plain.join(domains.select(F.col("norm").alias("domain"), F.col("surrogate").alias("host")), "domain", "left").select("mention", "type", "norm", "host")
    entities = surrogates(plain.select("type", "norm", "host").union(names.select("type", "norm", F.lit(None).cast("string"))), key)
    free = F.when(F.col("type").isin("card", "phone", "ssn", "iban"), _written(m, F.col("surrogate"))).otherwise(F.col("surrogate"))
    none = F.array().cast("array<struct<norm:string,surrogate:string>>")
    plain = plain.join(entities, ["type", "norm"]).select("mention", "type", free.alias("surrogate"), none.alias("parts"))
    whole = names.join(entities, ["type", "norm"]).groupBy("mention").agg(F.first("title").alias("title"), F.array_sort(F.collect_list(F.struct("at", "norm", "surrogate"))).alias("parts"))
    many = whole.select("mention", F.lit("name").alias("type"), F.concat("title", F.array_join(F.transform("parts", lambda x: x["surrogate"]), " ")).alias("surrogate"), F.transform("parts", lambda x: F.struct(x["norm"].alias("norm"), x["surrogate"].alias("surrogate"))).alias("parts"))
    return durable(plain.union(many))


def _bare(piece: Column, people: Column) -> Column:
    """`piece` with every word that is a name of `people` (a map to surrogates) exchanged, also before 's."""
    known = lambda w: F.try_element_at(people, w)
    owner = lambda w: F.regexp_extract(w, "^(.+)['’]s$", 1)
    words = F.regexp_extract_all(piece, F.lit(r"\p{L}++(?:['’-]\p{L}++)*+|[^\p{L}]++"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.coalesce(known(w), F.concat(known(owner(w)), F.substring(w, -2, 2)), w)), "")


def replace_pii(docs: DataFrame, key: str, text: str = "text", replaced: str = "text", counts: str | None = "pii_types") -> DataFrame:
    """`docs` with every mention in `text` replaced by its surrogate, in column `replaced`.

    `counts` names an added map of mentions by type (null: none is added). Null text stays null, an
    empty one empty; a text without mentions is not changed. Equal entities have equal surrogates in all
    rows, different ones different surrogates of their kind; another key gives others. Mentions never
    overlap: the leftmost wins, then the order of PATTERNS. Columns named like an output are replaced,
    all others kept; an empty table stays empty.

    Only documents with a mention are written once and joined with the replacements of their own
    mentions, by a digest of these, so that copies share an entry; all others pass as they are.
    """
    own = [c for c in docs.columns if c not in (replaced, counts) or c == text]
    marked = docs.select(*[F.col(f"`{c}`") for c in own]).withColumn("__vf_found", F.coalesce(mentions(F.col(f"`{text}`")), F.array().cast("array<string>")))
    clean = marked.where(F.size("__vf_found") == 0).withColumn("__vf_new", F.col(f"`{text}`"))
    found = F.array_distinct("__vf_found")
    touched = durable(marked.where(F.size("__vf_found") > 0).withColumn("__vf_k", F.sha2(F.array_join(found, "\x01").cast("binary"), 256)))
    each = touched.groupBy("__vf_k").agg(F.first("__vf_found").alias("found")).select(F.col("__vf_k").alias("k"), F.explode(F.array_distinct("found")).alias("mention"))
    each = durable(each)
    table = mention_table(each, key)
    mine = F.map_from_entries(F.collect_list(F.struct("mention", F.struct("surrogate", "type"))))
    people = F.flatten(F.collect_list(F.when(F.col("type") == "name", F.col("parts"))))
    maps = each.join(table, "mention").groupBy("k").agg(mine.alias("__vf_map"), F.array_sort(F.array_distinct(people)).alias("people"))
    # a word that is a name of two people of the document is the first's
    firsts = F.filter("people", lambda x, i: (i == 0) | (F.get(F.col("people"), i - 1)["norm"] != x["norm"]))
    maps = durable(maps.select(F.col("k").alias("__vf_k"), "__vf_map", F.map_from_entries(firsts).alias("__vf_people")))
    size = maps.agg(F.sum(F.length(F.to_json("__vf_map")) + F.length(F.to_json("__vf_people")) + 200)).first()[0] or 0
    joined = touched.join(F.broadcast(maps) if size <= BROADCAST_BYTES else maps, "__vf_k", "left")
    new = lambda x: F.coalesce(F.try_element_at(F.col("__vf_map"), x)["surrogate"], x, F.lit(""))
    # a name that is also a word of the calendar, or that the document writes in small letters, may be that word
    small = lambda k: F.regexp_like(F.col(f"`{text}`"), F.concat(F.lit(rf"(?<!{_WORD})"), F.lower(k), F.lit(rf"(?!{_WORD})")))
    certain = F.map_filter("__vf_people", lambda k, _: ~k.isin(CALENDAR) & ~(small(k) & (F.lower(k) != k)))
    joined = joined.withColumn("__vf_people", F.when(F.size("__vf_people") > 0, certain))
    plain = lambda p: F.when(F.size("__vf_people") > 0, _bare(p, F.col("__vf_people"))).otherwise(p)
    pieces = F.zip_with(F.split(F.col(f"`{text}`"), MENTION, -1), F.col("__vf_found"), lambda p, x: F.concat(plain(p), F.when(x.isNull(), F.lit("")).otherwise(new(x))))
    joined = joined.withColumn("__vf_new", F.when(F.col("__vf_map").isNotNull(), F.array_join(pieces, "")).otherwise(F.col(f"`{text}`")))
    if counts:
        kinds = F.filter(F.transform("__vf_found", lambda x: F.try_element_at(F.col("__vf_map"), x)["type"]), lambda t: t.isNotNull())
        tally = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(kinds)), lambda t: F.struct(t, F.size(F.filter(kinds, lambda x: x == t)))))
        joined = joined.withColumn("__vf_counts", F.coalesce(tally, F.create_map().cast("map<string,int>")))
        clean = clean.withColumn("__vf_counts", F.create_map().cast("map<string,int>"))
    order = [c for c in docs.columns if c != counts]
    chosen = {c: F.col(f"`{c}`") for c in own if c != replaced} | {replaced: F.col("__vf_new")}
    if replaced not in order:
        order.append(replaced)
    last = [chosen[c].alias(c) for c in order] + ([F.col("__vf_counts").alias(counts)] if counts else [])
    return clean.select(*last).union(joined.select(*last))
