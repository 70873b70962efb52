"""PII surrogates, in built-in functions only.

Detected entities are replaced by keyed surrogates of their type. An entity's identity is its normal form (letters and
digits in lower case), so all its mentions, however they are punctuated or cased, get one surrogate: coreference holds
within and across documents. A surrogate keeps length, script, letter case and punctuation of the mention; card numbers
keep their first digit and whether the Luhn check holds, IBANs their country and whether the check digits hold, phone
numbers their country code, IPv4 octets stay octets, e-mail addresses keep their domain.

Persons: names are learnt from mentions with a title ("Dr. Maria Lopez"), after words that introduce a person ("my name
is Maria Lopez") and from pairs of capitalised words whose first one is a given name of such a mention anywhere in the
corpus ("Maria Lopez and John Smith"). Every name has one surrogate, whatever its title or place: whether it is a given
or a family name, and the gender of a given name, follow from all its mentions together. In a document all capitalised
words equal to one of its names are replaced, so "Maria" and "Lopez" on their own are, too. Titles stay.

One pass finds the mentions of all texts (one scan for entities, one for persons); only mentions move. All patterns are
linear: each starts at a word's start, takes what it can without giving back, or is of bounded length. Then distinct
normal forms get their surrogates, and texts with mentions are woven anew where they are joined with them.

Collision check: all distinct normal forms of the corpus get their surrogates by attempt 0. If two would share one, the
smallest keeps it; so does none whose surrogate is some other entity's real value. The others try again with the next
attempt, until all differ. Only distinct entities take part, in tables of their own. After ``MAX_ATTEMPTS`` a form is
taken as crowded (as short numbers or one-letter local parts can be): from then on each attempt lengthens the surrogate
by one more character (an IPv4 address by one more octet), so that there always are free ones.

Defined edge cases: a null text stays null and has no entity; entities at either end of a text, touching ones and
repeated ones are all replaced; repeated rows get equal texts; null ids are allowed; other columns, whatever their
names, pass through (but n_entities, which is made anew); an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import cut

#: Where the key comes from in the registered query: this setting of the session, else a key for tests only.
KEY_SETTING, TEST_KEY = "spark.clauseloom.pii.key", "key-for-tests"
MAX_ATTEMPTS = 30
SALTS = 8
_B = r"(?<![\p{L}\p{N}_])"
_E = r"(?![\p{L}\p{N}_])"
MALE = "Mr|Herr|Sr|Señor|Don|M|Monsieur"
FEMALE = "Mrs|Ms|Miss|Frau|Sra|Señora|Doña|Mme|Mlle|Madame"
NEUTRAL = "Dr|Prof"
CUES = "[Mm]y name is|[Nn]ame:|[Ss]igned by|[Rr]egards,|[Ss]incerely,|[Cc]ontact:|[Aa]uthor:|[Ii]ch heiße|[Jj]e m['’]appelle|[Mm]e llamo"
NAME = r"\p{Lu}[\p{L}’'-]++(?![\p{N}_@])"
#: Kind and pattern; the first kind whose pattern matches a mention is its kind.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[._%+-]*+[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++){1,126}",
    "secret": rf"{_B}(?:[0-9a-fA-F]{{32,}}+|AKIA[0-9A-Z]{{16}}|(?:ghp|gho|sk|pk)_[0-9A-Za-z_]{{20,}}+){_E}",
    "ip": rf"(?<![\p{{L}}\p{{N}}_.])[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}(?!\.?[\p{{L}}\p{{N}}_])",
    "phone": rf"(?<![\p{{L}}\p{{N}}_+])(?:\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)|[0-9]{{1,4}})(?:[ .-]?[0-9]{{2,4}}){{1,4}}|\([0-9]{{3}}\) ?[0-9]{{3}}[ .-][0-9]{{4}}|[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}){_E}",
    "iban": rf"{_B}[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?{_E}",
    "card": rf"{_B}[0-9](?:[ -]?[0-9]){{12,18}}{_E}",
    "ssn": rf"{_B}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_E}",
}
ENTITY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Evidence of persons: after a title, after a cue, or two capitalised words.
TITLED = rf"(?:{MALE}|{FEMALE}|{NEUTRAL})\.? {NAME}(?: {NAME})?"
CUED = rf"(?:{CUES}) {NAME}(?: {NAME})?"
PERSON = rf"{_B}(?:{TITLED}|{CUED}|{NAME} {NAME})"
#: Country calling codes are one of these or have three digits.
CALLING = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
ONSETS = "b d f g k l m n p r s t v z br dr gr kr pl st tr".split()
CYRILLIC = "б в г д к л м н п р с т".split()
GREEK = "β γ δ θ κ λ μ ν π ρ σ τ".split()
LATIN = "abcdefghijklmnopqrstuvwxyz"
#: Letters by script; letters of any other script become Latin ones.
SCRIPTS = {
    "Cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "Greek": "αβγδεζηθικλμνξοπρστυφχψω", "Arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "Hebrew": "אבגדהוזחטיכלמנסעפצקרשת",
    "Han": "一三上下中主之九二五人今信八六具力化十千卡去口古可右合同名土地型城大天好子安小山工左市平広心手文方日明月有木本東林水火生田白百目石立米虫行見言赤足車里金長門雨青音高",
    "Hiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ", "Katakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ",
    "Hangul": "가나다라마바사아자차카타파하고노도로모보소오조초코토포호구누두루무부수우주추쿠투푸후", "Devanagari": "अआइईउऊएऐओऔकखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह", "Thai": "กขคงจฉชซญดตถทธนบปผฝพฟภมยรลวศสหอฮ",
}


def kind_of(mention: Column) -> Column:
    out = F
    for kind, pattern in KINDS.items():
        out = out.when(mention.rlike(rf"\A(?:{pattern})\z"), F.lit(kind))
    return out.otherwise(F.lit("phone"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is made once; named in a lambda as it stands, it would be made again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), 0)


def _plain(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def norm_of(mention: Column, kind: Column) -> Column:
    """Normal form of an entity's mention."""
    return (
        F.when(kind == "email", F.lower(F.regexp_replace(mention, r"\A[._%+-]+", ""))).when(kind == "ip", mention)
        .when(kind == "phone", F.concat(F.when(mention.startswith("+"), "+").otherwise(""), _plain(mention))).otherwise(_plain(mention))
    )


def _digest(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), norm).cast("binary"), 256)


def _byte(digest: Column, i: Column) -> Column:
    return F.conv(F.substring(digest, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _scramble(text: Column, digest: Column, hexed: Column) -> Column:
    """Digits become digits, letters become letters of their script; hexadecimal text stays hexadecimal."""
    def any_of(letters: str, x: Column) -> Column:
        return F.substring(F.lit(letters), F.pmod(x, F.lit(len(letters))) + 1, F.lit(1))

    def one(c: Column, i: Column) -> Column:
        x = _byte(digest, i + F.floor(i / 32).cast("int"))
        out = F.when(hexed & c.rlike("[0-9a-f]"), any_of("0123456789abcdef", x)).when(c.rlike("[0-9]"), F.pmod(x, F.lit(10)).cast("string")).when(c.rlike("[a-z]"), any_of(LATIN, x))
        for script, letters in SCRIPTS.items():
            out = out.when(c.rlike(rf"\p{{Is{script}}}"), any_of(letters, x))
        return out.when(c.rlike(r"\p{L}"), any_of(LATIN, x)).when(c.rlike(r"\p{N}"), F.pmod(x, F.lit(10)).cast("string")).otherwise(c)

    return F.array_join(F.transform(_chars(text), one), "")


def _mod97(text: Column) -> Column:
    """Remainder by 97 of the number that digits, and letters as 10 to 35, spell."""
    return F.aggregate(_chars(text), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 87) % 97))


def surrogate(kind: Column, norm: Column, attempt: Column, key: str, extra: int = 0) -> Column:
    """Surrogate of a normal form, itself a normal form; ``extra`` characters longer (octets for an IPv4 address).

    Kinds: those of ``KINDS``, and name-m, name-f, name-n (given names), name-l (family names).
    """
    digest = _digest(F.when(kind.startswith("name"), "name").otherwise(kind), norm, attempt, key)
    return _let(F.struct(digest.alias("d"), norm.rlike(r"\A[0-9a-f]{32,}+\z").alias("hexed")), lambda x: _drawn(kind, norm, attempt, x["d"], x["hexed"], extra))


def _drawn(kind: Column, norm: Column, attempt: Column, d: Column, all_hex: Column, extra: int) -> Column:
    longer = F.concat(norm, F.lit("0" * extra))
    plain = _scramble(longer, d, all_hex)
    local = F.concat(F.substring_index(norm, "@", 1), F.lit("0" * extra))
    email = F.concat(_scramble(local, d, F.lit(False)), F.lit("@"), F.substring_index(norm, "@", -1))
    ip = F.array_join(F.transform(F.split(F.concat(norm, F.lit(".0" * extra)), r"\."), lambda o, i: (F.pmod(_byte(d, i), F.lit(254)) + 1).cast("string")), ".")
    head = F.concat(F.substring(norm, 1, 1), F.substring(plain, F.lit(2), F.greatest(F.length(longer) - 2, F.lit(0))))
    last = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.pmod(k + _byte(d, F.lit(31)), F.lit(10)).cast("string")), lambda x: F.call_function("luhn_check", F.concat(head, x)) == F.call_function("luhn_check", norm))
    card = F.concat(head, F.get(last, F.lit(0)))
    country, account = F.substring(norm, 1, 2), _scramble(F.substring(longer, F.lit(5), F.length(longer)), d, F.lit(False))
    rotated = lambda check: F.concat(account, country, check)
    digits = F.lpad((98 - _mod97(rotated(F.lit("00")))).cast("string"), 2, "0")
    wrong = F.lpad(F.pmod(digits.cast("int") + 1 + F.pmod(_byte(d, F.lit(30)), F.lit(90)), F.lit(97)).cast("string"), 2, "0")
    valid = _mod97(F.concat(F.substring(norm, F.lit(5), F.length(norm)), F.substring(norm, 1, 4))) == 1
    iban = F.concat(country, F.when(valid, digits).otherwise(wrong), account)
    kept = F.length(F.regexp_extract(norm, rf"\A(?:\+(?:{CALLING}|[0-9]{{3}})|[0-9])", 0))
    phone = F.concat(F.substring(norm, F.lit(1), kept), F.substring(plain, kept + 1, F.length(longer)))

    def syllables(onsets: list[str], vowels: str) -> Column:
        return F.array_join(
            F.transform(
                F.sequence(F.lit(0), F.lit(2) + attempt),
                lambda i: F.concat(F.get(F.lit(onsets), F.pmod(_byte(d, i * 2), F.lit(len(onsets)))), F.substring(F.lit(vowels), F.pmod(_byte(d, i * 2 + 1), F.lit(len(vowels))) + 1, F.lit(1))),
            ),
            "",
        )

    cyrillic, greek = norm.rlike(r"\p{IsCyrillic}"), norm.rlike(r"\p{IsGreek}")
    stem = F.when(cyrillic, syllables(CYRILLIC, "аеиоу")).when(greek, syllables(GREEK, "αειο")).otherwise(syllables(ONSETS, "aeiou"))
    end = lambda c, g, l: F.when(cyrillic, c).when(greek, g).otherwise(l)
    tail = F.when(kind == "name-f", end("на", "να", "na")).when(kind == "name-m", end("н", "ν", "n")).when(kind == "name-l", end("вич", "ιδης", "sen")).otherwise("")
    return (
        F.when(kind.startswith("name"), F.concat(stem, tail))
        .when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "iban", iban).when(kind == "phone", phone)
        .otherwise(plain)
    )


def assign(entities: DataFrame, key: str, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """(kind, norm, surrogate) for distinct (kind, norm): surrogates differ from each other and from all real values.

    All kinds of names share one space; a name has one kind only.
    """
    space = F.when(F.col("kind").startswith("name"), "name").otherwise(F.col("kind"))
    real = cut(entities.select("kind", "norm").distinct().withColumn("space", space))
    todo, done = real, None
    for attempt in count():
        extra = max(0, attempt - max_attempts + 1)
        tried = cut(todo.select("kind", "space", "norm", surrogate(F.col("kind"), F.col("norm"), F.lit(attempt), key, extra).alias("surrogate")))
        taken = real.select("space", F.col("norm").alias("surrogate"))
        if done is not None:
            taken = taken.unionByName(done.select("space", "surrogate"))
        first = tried.groupBy("space", "surrogate").agg(F.min(F.struct("norm", "kind")).alias("x")).select("space", "surrogate", "x.norm", "x.kind")
        good = cut(first.join(taken, ["space", "surrogate"], "left_anti"))
        done = good if done is None else done.unionByName(good)  # each part is cut; what is done is not written again
        todo = cut(tried.select("kind", "space", "norm").join(good, ["space", "norm"], "left_anti"))
        if todo.isEmpty():
            return done.select("kind", "norm", "surrogate")


def render(mention: Column, fill: Column) -> Column:
    """The mention with its letters and digits, from left to right, taken from the surrogate ``fill``."""
    kind = kind_of(mention)
    letter = r"[\p{L}\p{N}]"
    capitals = (F.upper(mention) == mention) & (F.lower(mention) != mention)
    old, new = F.regexp_extract_all(mention, F.lit(f"({letter})"), 1), F.regexp_extract_all(fill, F.lit(f"({letter})"), 1)
    set_in = _let(capitals, lambda all_upper: F.filter(F.zip_with(old, new, lambda c, n: F.when(c.isNotNull(), F.when(all_upper | c.rlike(r"\p{Lu}"), F.upper(n)).otherwise(n))), lambda c: c.isNotNull()))
    woven = F.zip_with(F.split(mention, letter, -1), set_in, lambda s, c: F.concat(s, F.coalesce(c, F.lit(""))))
    rest = F.slice(new, F.size(old) + 1, F.greatest(F.size(new) - F.size(old), F.lit(0)))  # of a lengthened surrogate
    lead, address = F.regexp_extract(mention, r"\A[._%+-]*", 0), F.regexp_replace(mention, r"\A[._%+-]+", "")
    local, new_local = F.substring_index(address, "@", 1), F.substring_index(fill, "@", 1)
    email = F.concat(lead, F.when((F.upper(local) == local) & (F.lower(local) != local), F.upper(new_local)).otherwise(new_local), F.lit("@"), F.substring_index(address, "@", -1))
    return F.when(kind == "email", email).when(kind == "ip", fill).otherwise(F.concat(F.array_join(woven, ""), F.array_join(rest, "")))


def named_persons(evidence: DataFrame) -> DataFrame:
    """(id, th, norm, kind): the names of each document, out of its evidence (id, th, hit); one kind for each name.

    A pair of capitalised words without title or cue counts if its first word is the given name of a person elsewhere.
    """
    hit = F.col("hit")
    names = F.split(F.regexp_replace(hit, rf"\A(?:(?:{MALE}|{FEMALE}|{NEUTRAL})\.?|{CUES}) ", ""), " ")
    gender = F.when(hit.rlike(rf"\A(?:{MALE})\.? "), "m").when(hit.rlike(rf"\A(?:{FEMALE})\.? "), "f").otherwise("n")
    sure = hit.rlike(rf"\A(?:{TITLED}|{CUED})\z")
    read = evidence.select("id", "th", sure.alias("sure"), gender.alias("gender"), F.transform(names, lambda n: F.lower(n)).alias("names"))
    role = lambda i: F.when(F.size("names") == 1, "alone").when(i == 0, "given").otherwise("family")
    spread = lambda df: df.select("id", "th", "gender", F.explode(F.transform("names", lambda n, i: F.struct(n.alias("norm"), role(i).alias("role")))).alias("x")).select("id", "th", "gender", "x.norm", "x.role")
    certain = cut(spread(read.filter("sure")))
    given = certain.filter("role = 'given'").select(F.col("norm").alias("g")).distinct()
    pairs = read.filter(~F.col("sure")).join(given, F.get("names", F.lit(0)) == F.col("g"), "left_semi")
    each = cut(certain.unionByName(spread(pairs)).distinct())
    n = lambda c: F.count_if(c)
    votes = each.groupBy("norm").agg(n(F.col("role") == "given").alias("given"), n(F.col("role") == "family").alias("family"), n((F.col("gender") == "f") & (F.col("role") != "family")).alias("f"), n((F.col("gender") == "m") & (F.col("role") != "family")).alias("m"))
    kind = F.when((F.col("given") == 0) | (F.col("family") > F.col("given")), "name-l").when(F.col("f") > F.col("m"), "name-f").when(F.col("m") > F.col("f"), "name-m").otherwise("name-n")
    return each.select("id", "th", "norm").distinct().join(votes.select("norm", kind.alias("kind")), "norm")


def replace_pii(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with surrogates in the text and, last, n_entities (replaced mentions); n_chars follows the text."""
    t = F.col(text)
    scan = lambda pattern: F.regexp_extract_all(t, F.lit(f"({pattern})"), 1)
    place = lambda x, i: F.struct(i.alias("at"), x.alias("hit"))
    every = F.concat(F.transform(scan(ENTITY), place), F.transform(F.array_distinct(scan(PERSON)), lambda x: place(x, F.lit(-1))))
    hits = cut(docs.select(F.col(doc_id).alias("id"), F.xxhash64(t).alias("th"), F.explode_outer(every).alias("x")).filter("x is not null").select("id", "th", "x.at", "x.hit").distinct())  # explode would add a filter on the array's size and so scan twice
    found = hits.filter("at >= 0").withColumn("kind", kind_of(F.col("hit")))
    found = cut(found.withColumn("norm", norm_of(F.col("hit"), F.col("kind"))))
    people = cut(named_persons(hits.filter("at < 0").select("id", "th", "hit")))
    given = assign(found.select("kind", "norm").unionByName(people.select("kind", "norm")), key)
    # an entity may be that of a third of all texts, so the join is salted
    salted = given.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod("th", F.lit(SALTS)).cast("int")
    drawn = found.withColumn("salt", salt).join(salted, ["kind", "norm", "salt"]).select("id", "th", "at", render(F.col("hit"), F.col("surrogate")).alias("v"))
    drawn = drawn.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("l")).select("id", "th", F.transform("l", lambda x: x["v"]).alias("drawn"))
    # maps are searched from end to end, so a document's names are spread over small ones
    called = people.withColumn("salt", salt).join(salted, ["kind", "norm", "salt"]).groupBy("id", "th", _bucket(F.col("norm")).alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("norm", "surrogate"))).alias("m"))
    called = called.groupBy("id", "th").agg(F.map_from_entries(F.collect_list(F.struct("b", "m"))).alias("called"))
    news = drawn.withColumn("called", F.lit(None).cast("map<int,map<string,string>>")).unionByName(called.withColumn("drawn", F.lit(None).cast("array<string>")))
    news = news.groupBy(F.col("id").alias("mid"), F.col("th").alias("mth")).agg(F.first("drawn", True).alias("drawn"), F.first("called", True).alias("called"))
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("rid"), F.xxhash64(t).alias("rth"))
    both = row.join(news, F.col("rid").eqNullSafe(F.col("mid")) & (F.col("rth") == F.col("mth")), "left")
    t = F.col("row").getField(text)
    word = rf"{_B}{NAME}"
    cased = lambda old, new: F.when((F.upper(old) == old) & (F.length(old) > 1), F.upper(new)).otherwise(F.initcap(new))
    name_of = lambda w: F.element_at(F.element_at("called", _bucket(F.lower(w))), F.lower(w))

    def renamed(piece: Column) -> Column:
        """struct(text, n): the piece with its document's names replaced, and how many they are."""
        words = F.transform(F.regexp_extract_all(piece, F.lit(f"({word})"), 1), lambda w: F.struct(w.alias("w"), cased(w, name_of(w)).alias("v")))
        woven = F.zip_with(F.split(piece, word, -1), words, lambda p, x: F.concat(p, F.coalesce(x["v"], x["w"], F.lit(""))))
        return F.struct(F.array_join(woven, "").alias("t"), F.size(F.filter(words, lambda x: x["v"].isNotNull())).alias("n"))

    # a text without mentions is not touched: each of its steps is null
    changed = F.col("drawn").isNotNull() | F.col("called").isNotNull()
    cutup = both.select("row", "drawn", "called", F.when(changed, F.split(t, ENTITY, -1)).alias("pieces"))
    named = F.when(F.col("called").isNotNull(), F.transform("pieces", renamed)).otherwise(F.transform("pieces", lambda p: F.struct(p.alias("t"), F.lit(0).alias("n"))))
    told = cutup.select("row", "drawn", named.alias("p"))
    drawn = F.coalesce("drawn", F.array().cast("array<string>"))
    new = F.array_join(F.zip_with("p", drawn, lambda p, v: F.concat(p["t"], F.coalesce(v, F.lit("")))), "")
    n = F.size(drawn) + F.aggregate("p", F.lit(0), lambda a, p: a + p["n"])
    done = told.select("row", F.when(F.col("p").isNull(), t).otherwise(new).alias("new"), F.coalesce(n, F.lit(0)).cast("long").alias("n_entities"))
    return done.select(*[F.col("new").alias(c) if c == text else F.length("new").cast("long").alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns if c != "n_entities"], "n_entities")


def _bucket(norm: Column) -> Column:
    return F.pmod(F.hash(norm), F.lit(512))


def op6_pii_surrogates(docs: DataFrame) -> DataFrame:
    return replace_pii(docs.select("doc_id", "text"), docs.sparkSession.conf.get(KEY_SETTING, TEST_KEY))
