"""Personal information inside free text.

Method: bootstrapped contextual extraction. Generous shapes give candidate spans
of each kind. Some are seeds, by their form alone (an address with @ or written
out, a number with a country code, an identity number that holds a date, a house
number with a street, a title with a surname). The words beside a candidate are
its patterns. Spark scores the graph of patterns and instances in rounds: a
pattern holds if enough different instances are known in it and they are a large
share of all it matches; a name part is known if most of its mentions are
accepted; accepted patterns and known parts accept further candidates, which
feed the next round. A last pass replaces the accepted spans by placeholders.

Texts are read in the form of quillgraph.llm.canonical, so full-width digits,
look-alike letters and invisible characters do not hide anything.

Defined cases: null and empty texts have no cases; line numbers count pieces split
at the line feed, from 1; repeated rows count once; texts of any length are read
whole; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.canonical import canonical, canonical_each, tables
from quillgraph.llm.textio import mapped
from quillgraph.runtime import broadcast_if_small, checkpoint

KINDS = ("email", "phone", "id_number", "address", "name")
ROUNDS = 3
#: A pattern holds from so many known instances and this share of all its instances.
LEAST_KNOWN = 3
PATTERN_SHARE = {"phone": 0.08, "id_number": 0.15, "address": 0.15, "name": 0.06}
#: A name part is known if this share of its mentions is accepted, in so many instances.
PART_SHARE = 0.5
PART_INSTANCES = 2
#: A Chinese surname is a common word more often: less of its mentions, but more instances.
SURNAME_SHARE = 0.08
SURNAME_INSTANCES = 3
HAN_START = "^[\\u3400-\\u9fff]"

# Words that stand before or after a person's name, and kinds of streets.
TITLES = "Dr|Prof|Professor|Mr|Mrs|Ms|Miss|Herr|Frau|Mme|Mlle|Madame|Monsieur"
HONORIFICS = "老师|同学|先生|女士|教授|博士|小姐|师傅"
STREETS = "Street|St|Lane|Ln|Road|Rd|Avenue|Ave|Close|Crescent|Terrace|Way|Drive|Court|Square|Place|Row|Boulevard|Blvd|Gardens|Hill|Mews|Walk"
RUES = "rue|avenue|boulevard|allée|place|chemin|impasse|quai|route|cours|passage|square"
# Chinese surnames that seed the search, of two characters and of one those that are hardly words of their own; other surnames are discovered.
COMPOUND = (
    "欧阳 太史 端木 上官 司马 东方 独孤 南宫 万俟 闻人 夏侯 诸葛 尉迟 公羊 赫连 澹台 皇甫 宗政 濮阳 公冶 太叔 申屠 公孙 慕容 仲孙 钟离 长孙 宇文 司徒 鲜于 司空 闾丘 子车 "
    "亓官 司寇 巫马 公西 颛孙 壤驷 公良 漆雕 乐正 宰父 谷梁 拓跋 夹谷 轩辕 令狐 段干 百里 呼延 东郭 南门 羊舌 微生 梁丘 左丘 西门 第五"
).split()
SINGLE = (
    "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦许吕施张孔曹严魏陶姜戚谢邹喻柏窦潘葛奚范彭郎鲁韦苗凤俞袁柳鲍唐费廉岑薛雷贺倪汤滕殷罗郝邬傅卞齐伍顾孟黄穆萧尹姚邵汪祁臧戴宋茅庞熊纪舒屈董梁杜阮蓝"
    "闵贾娄郭梅刁钟徐邱骆夏蔡樊胡凌霍虞柯莫房裘缪宗邓郁杭洪崔龚嵇邢裴陆荀羊惠甄芮储靳汲邴糜宓蓬郗郦邰鄂赖蔺屠蒙乔胥翟谭逄姬扶冉雍璩桑濮扈燕冀浦庄晏瞿阎慕茹宦艾廖庾居匡寇阙殳隆厍聂晁敖訾阚乜鞠巢蒯荆权逯盖桓鄢闫覃尉岳帅缑亢郈琴仉墨哈谯笪佘佴麴"
)
HAN = "㐀-䶿一-鿿"
UP, LOW = "A-ZÀ-ÖØ-ÞŠŽŒ", "a-zß-öø-ÿšžœ"
CAP = rf"[{UP}][{LOW}]+(?:[-'’][{UP}]?[{LOW}]+)*"
EMAIL = re.compile(
    r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*\s?(?:@|[\[({<]\s*(?:at|@|AT|At)\s*[\])}>]|\s(?:at|AT)\s(?=[\w-]+\s?(?:[\[({<]\s*|\s)(?:dot|DOT)))\s?"
    r"[A-Za-z0-9-]+(?:\s?(?:\.|[\[({<]\s*(?:dot|DOT|Dot)\s*[\])}>]|\s(?:dot|DOT)\s)\s?[A-Za-z0-9-]+)*?\s?(?:\.|[\[({<]\s*(?:dot|DOT|Dot)\s*[\])}>]|\s(?:dot|DOT)\s)\s?[A-Za-z]{2,}(?![A-Za-z0-9])",
    re.ASCII,
)
# a pattern that begins with a set of characters is looked for from one of them to the next
#: An @ written out, with signs around it or a dot written out too.
AT_IN_SIGNS, DOT_WRITTEN = re.compile(r"[\[({<]\s*(?:at|At|AT)\s*[\])}>]"), re.compile(r"\s(?:dot|DOT)\s")
NUMBER = re.compile(r"(?<![0-9A-Za-z.,/=^_#+-])(?:[A-Z]{2}\s?[0-9]{2}\s?[0-9]{2}\s?[0-9]{2}\s?[A-D](?![A-Za-z0-9])|(?:\+|00)?\(?[0-9](?:(?:[ ./–-]{0,2}|\)[ -]?|[ ]\()[0-9]){5,20}[Xx]?)(?![0-9A-Za-z^_])(?:\s?(?:ext\.?|x|转|Durchwahl|poste)\s?[0-9]{1,5})?")
#: The six digits without which there is no number, and the signs that stand before the first of them at most.
DIGITS, BEFORE_DIGITS = re.compile(r"[0-9](?:[\s./–()-]{0,2}[0-9]){5}"), 4
DATE_IN_ID = re.compile(r"[0-9]{6}(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx]")
# each pattern begins with what is rare in a text, the rest is read from there
STREET = re.compile(rf"[0-9][0-9]{{0,3}}[A-Za-z]?,?\s(?:{CAP}\s){{1,3}}(?P<kind>(?:{STREETS})\b\.?)?")
BEFORE_STREET = re.compile(r"(?:(?:Flat|Apt\.?|Unit|Suite)\s[0-9]+[A-Z]?,\s)?(?:No\.\s)?$")
RUE = re.compile(rf"[0-9][0-9]{{0,3}}(?:\s(?:bis|ter))?,?\s(?:{RUES})\s(?:(?:de|du|des|la|le|l['’]|d['’])\s?)*{CAP}")
STRASSE = re.compile(rf"[{UP}][{LOW}-]+(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring)\s[0-9]{{1,4}}[a-z]?(?![0-9])")
LU = re.compile(r"[路街巷道弄里村胡](?:(?<!胡)|(?<=胡)同)\s?[0-9]{1,5}\s?[号弄](?:\s?[0-9]{1,5}\s?(?:号|栋|幢|单元|楼|室))*")
BEFORE_LU = re.compile(rf"(?:[{HAN}]{{2}}[省市])?(?:[{HAN}]{{2}}[市区县镇])?[{HAN}]{{2,3}}$")
RUE_WORDS, STRASSE_WORDS = RUES.split("|"), ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "ufer", "damm", "ring")


def addresses(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, sure) of house numbers with a street; not sure where no kind of street is named."""
    for m in STREET.finditer(text):
        a, b = m.span()
        if not (text[a - 1 : a].isalnum() or text[a - 1 : a] in (".", "=", "^", "_")):
            if text[a - 1 : a].isspace() and (text[a - 1] != " " or text[a - 2 : a - 1] in (",", ".")):
                a = BEFORE_STREET.search(text, max(0, a - 16), a).start()
            yield a, b, m["kind"] is not None
    if any(w in text for w in RUE_WORDS):
        for m in RUE.finditer(text):
            if not text[m.start() - 1 : m.start()].isalnum():
                yield *m.span(), True
    if any(w in text for w in STRASSE_WORDS):
        for m in STRASSE.finditer(text):
            yield *m.span(), True
    for m in LU.finditer(text):
        if before := BEFORE_LU.search(text, max(0, m.start() - 9), m.start()):
            yield before.start(), m.end(), True


STREET_IN_CAPS = re.compile(rf"[0-9](?<![0-9A-Za-z.][0-9])[0-9]{{0,3}}[A-Z]?,?\s(?:[A-Z][A-Z-]+\s){{1,3}}(?:{STREETS.upper()})\b")
TITLE_ENDS = "|".join(f"(?<={c})(?:{'|'.join(t[1:] for t in TITLES.split('|') if t[0] == c)})" for c in sorted({t[0] for t in TITLES.split("|")}))
CAP_END = CAP.removeprefix(f"[{UP}]")
#: Two words or initials in capitals, a title with a name, or a surname before its given name.
RUN = re.compile(
    rf"[{UP}](?:(?:{TITLE_ENDS})\b\.?\s+(?:[{UP}]\.\s?)*{CAP}(?:[ ]{{1,3}}{CAP})*"
    rf"|(?:{CAP_END}|\.)(?:(?:[ ]{{1,3}}(?:{CAP}|[{UP}]\.(?=\W|$)))+|,[ ](?!(?:{TITLES})\b){CAP}(?![ ](?:{CAP}|[{UP}]\.)|,[ ]{CAP}|\w)))"
)
TITLED = re.compile(rf"\b(?:{TITLES})\b\.?\s+(?:[{UP}]\.\s?)*{CAP}")
SURNAME_START = re.compile(f"[{SINGLE}{''.join(x[0] for x in COMPOUND)}]")
HAN_NAME = re.compile(rf"((?:{'|'.join(COMPOUND)})|[{SINGLE}])([{HAN}]{{1,2}})")
#: Whatever stands alone behind a colon, or before an honorific, may be a name of any surname.
HAN_ALONE = re.compile(rf"[：:][ 　]?([{HAN}]{{2,4}})(?![{HAN}])")
HONORIFIC = re.compile(HONORIFICS)
HAN_ONLY = re.compile(rf"[{HAN}]+")
# Characters that stand in no name, as particles and pronouns.
NO_NAME = re.compile("[的了和与及或在是有为对把被从各位你我他她它们这那个之不]")


WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[0-9]+|[^\w\s]")
HAN_OR_COLON, HAN_SIGN, ALL_DIGITS = re.compile(rf"[{HAN}：:]"), re.compile(rf"[{HAN}]"), re.compile("[0-9]+")


def left_words(text: str, a: int) -> str:
    part = text[max(0, a - 40) : a].rpartition("\n")[2]
    bare = part.rstrip()
    if bare and HAN_OR_COLON.match(bare[-1]):
        return ALL_DIGITS.sub("#", bare[-2:])
    words = WORDS.findall(part)[-2:]
    return " ".join("#" if w[0].isdigit() else w.lower() for w in words) or "^"


def right_words(text: str, b: int) -> str:
    part = text[b : b + 40].partition("\n")[0]
    bare = part.lstrip()
    if bare and HAN_SIGN.match(bare):
        return bare[:2]
    words = WORDS.findall(part)[:2]
    return " ".join("#" if w[0].isdigit() else w.lower() for w in words) or "$"


#: Without which nothing is set in capitals.
TWO_CAPITALS = re.compile("[A-Z][A-Z]")
CAPS_LINE = re.compile(r"^(?=[^\na-zß-ÿ]*$)(?:[^\n]*[A-Z]{3}){2}[^\n]*$", re.MULTILINE)


def caps_names(line: str, start: int, at: int, words: list[str]) -> Iterator[Candidate]:
    """Each pair of neighbouring words: the case no longer tells where a name begins and ends."""
    places = []
    for w in words:
        at = line.index(w, at)
        places.append(at)
        at += len(w)
    for k in range(len(words) - 1):
        a, b = places[k], places[k + 1] + len(words[k + 1])
        pair = words[k : k + 2]
        parts = [w for w in pair if len(w) > 2 and w.rstrip(".") not in TITLES.split("|")]
        if parts:
            yield "name", start + a, start + b, " ".join(pair), parts, TITLED.search(" ".join(pair)) is not None


Candidate = tuple[str, int, int, str, list[str], bool]


def before_honorifics(text: str, found: set[tuple[int, int]]) -> Iterator[Candidate]:
    """One to three characters of any kind before an honorific: what they are is left to the words before them."""
    for m in HONORIFIC.finditer(text):
        b = m.start()
        for n in (1, 2, 3):
            a = b - n
            if a < 0 or not HAN_ONLY.fullmatch(text, a, b) or NO_NAME.search(text, a, b):
                break
            bounded = a == 0 or not HAN_ONLY.match(text[a - 1])
            # a bare surname needs a clear beginning
            if (a, b) not in found and (n > 1 or bounded) and not HONORIFIC.search(text, a, b):
                found.add((a, b))
                yield "name", a, b, text[a:b], [], False


def candidates(text: str) -> Iterator[Candidate]:
    """(kind, start, end, instance, parts, seed) of a text in canonical form."""
    taken: list[tuple[int, int]] = []
    if "@" in text or AT_IN_SIGNS.search(text) or ("dot" in text or "DOT" in text) and DOT_WRITTEN.search(text):
        for m in EMAIL.finditer(text):
            taken.append(m.span())
            yield "email", *m.span(), re.sub(r"\s", "", m[0]).lower(), [], True
    digits_at = DIGITS.search(text)
    for m in NUMBER.finditer(text, max(0, digits_at.start() - BEFORE_DIGITS)) if digits_at else ():
        a, b = m.span()
        if any(x < b and a < y for x, y in taken[-40:]) or text[b : b + 1] in ("%", "="):
            continue
        raw = m[0]
        digits = re.sub(r"\D", "", re.split(r"ext|x|转|Durchwahl|poste", raw)[0]) if raw[0] not in "QABCDEFGHJKLMNOPRSTUVWXYZ" else ""
        if raw[0].isalpha():
            yield "id_number", a, b, raw.replace(" ", ""), [], True
            continue
        shape = re.sub(r"[0-9]", "9", raw)
        packed = re.sub(r"[^0-9Xx]", "", raw)
        if len(packed) in (17, 18) and DATE_IN_ID.fullmatch(packed):
            yield "id_number", a, b, packed, [], True
        elif shape == "999-99-9999":
            yield "id_number", a, b, packed, [], True
        elif len(digits) >= 8 and "+" not in raw and "(" not in raw:
            yield "id_number", a, b, digits, [], False
        if 6 <= len(digits) <= 15 and shape != "999-99-9999":
            sure = raw.startswith("+") and len(digits) >= 9 or re.match(r"\(0[0-9]{2,4}\)\s?[0-9]{3}", raw) is not None or re.search(r"(ext|转)", raw) is not None
            yield "phone", a, b, digits, [], bool(sure)
    for a, b, seed in addresses(text):
        if seed:
            taken.append((a, b))
        yield "address", a, b, re.sub(r"\s+", " ", text[a:b]).strip(), [], seed
    capitals = TWO_CAPITALS.search(text) is not None
    for m in STREET_IN_CAPS.finditer(text) if capitals else ():
        taken.append(m.span())
        yield "address", *m.span(), m[0].lower(), [], True
    taken.sort()
    starts = [x for x, _ in taken]

    def free(a: int, b: int) -> bool:
        k = bisect_right(starts, b)
        return not any(x < b and a < y for x, y in taken[max(0, k - 4) : k])

    for m in RUN.finditer(text):
        a, b = m.span()
        if ", " in m[0]:
            if free(a, b):
                yield "name", a, b, m[0], m[0].split(", "), False
            continue
        words = m[0].split()
        if text[a - 1 : a] in ("=", "^", "_", "{", "\\") and len(words[0]) == 2:
            # the end of a formula before a name
            a += len(words[0]) + 1
            words = words[1:]
        if len(words) < 2 or not free(a, b) or text[a - 1 : a] in ("=", "^", "_", "(", "{", "\\", "©"):
            continue
        if titled := TITLED.search(m[0]):
            yield "name", a + titled.start(), a + titled.end(), titled[0], [titled[0].split()[-1]], True
            continue
        parts = [w for w in words if len(w) > 2]
        if parts:
            yield "name", a, b, " ".join(words), parts, False
    for line in CAPS_LINE.finditer(text) if capitals else ():
        # set in capitals throughout: read as if in title case
        for m in RUN.finditer(line[0].title()):
            words = m[0].split()
            a, b = line.start() + m.start(), line.start() + m.end()
            if len(words) > 1 and free(a, b):
                yield from caps_names(line[0].title(), line.start(), m.start(), words)
    if text.isascii():
        return
    found: set[tuple[int, int]] = set()
    for first in SURNAME_START.finditer(text):
        if (m := HAN_NAME.match(text, first.start())) is None:
            continue
        family, given = m[1], m[2]
        a = m.start()
        for n in range(1, len(given) + 1):
            b = a + len(family) + n
            if HONORIFIC.match(text, b):
                found.add((a, b))
                yield "name", a, b, family + given[:n], [family], True
                break
        else:
            b = a + len(family) + len(given)
            right = text[b : b + 1]
            found |= {(a, b), (a, b - 1)} if len(given) == 2 and right else {(a, b)}
            yield "name", a, b, family + given, [family], False
            if len(given) == 2 and right:
                yield "name", a, b - 1, family + given[:1], [family], False
    for m in HAN_ALONE.finditer(text):
        if m.span(1) not in found and not HONORIFIC.search(m[1]):
            found.add(m.span(1))
            yield "name", *m.span(1), m[1], [m[1][0]], False
    yield from before_honorifics(text, found)


CANDIDATES = "doc_id long, line_no int, a int, b int, kind string, inst string, parts array<string>, seed boolean, l string, r string"


def candidate_table(documents: DataFrame) -> DataFrame:
    """One row a candidate, with its place in the canonical text and the patterns to its left and right."""
    known: dict[str, str] = {}

    def run(held: pa.Table) -> pa.Table:
        out: dict[str, list] = {name.split()[0]: [] for name in CANDIDATES.split(", ")}
        texts = canonical_each([BREAK.sub(" ", t) for t in held["text"].to_pylist()], known)
        for doc, text in zip(held["doc_id"].to_pylist(), texts):
            for kind, a, b, inst, parts, seed in candidates(text):
                row = (doc, text.count("\n", 0, a) + 1, a, b, kind, inst, parts, seed, left_words(text, a), right_words(text, b))
                for column, x in zip(out.values(), row):
                    column.append(x)
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.string(), pa.string()]
        return pa.table({name: pa.array(x, t) for (name, x), t in zip(out.items(), types)})

    docs = documents.select("doc_id", "text").filter("doc_id is not null and text <> ''")
    return mapped(docs, run, CANDIDATES, 500)


#: Other line ends are blanks here: lines are counted by the line feed alone.
BREAK = re.compile("[\r\x0b\x0c\x85\u2028\u2029]")


def share_of(kind: Column) -> Column:
    out = F.lit(1.0)
    for name, share in PATTERN_SHARE.items():
        out = F.when(kind == name, F.lit(share)).otherwise(out)
    return out


def patterns_of(mentions: DataFrame) -> DataFrame:
    """(m, kind, inst, side, pattern): each mention's left, right and joint pattern; a bare line end is a pattern only jointly."""
    # only a word or a colon, comma or dash beside the candidate says something by itself
    sides = F.array(
        F.when(F.col("l").rlike(r"[\p{L}:：,—-]$") | (F.col("kind").isin("phone", "id_number") & F.col("l").rlike(r"(^| )\p{L}{1,4} \.$")), F.concat(F.lit("L "), "l")),
        # what stands before an honorific is no name for that alone
        F.when(F.col("r").rlike(r"^\p{L}") & ((F.col("kind") == "address") | (F.col("kind") == "name") & (F.size("parts") > 0)), F.concat(F.lit("R "), "r")),
        F.concat(F.lit("B "), "l", F.lit(" | "), "r"),
    )
    exploded = mentions.select("m", "kind", "inst", F.explode(F.array_compact(sides)).alias("pattern"))
    return exploded.withColumn("side", F.substring("pattern", 1, 1))


def accepted(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The rows of candidate_table() that the bootstrapping accepts."""
    key = ["kind", "inst", "l", "r", "seed"]
    mentions = found.groupBy(*key).agg(F.first("parts").alias("parts"))
    mentions = checkpoint(mentions.withColumn("m", F.xxhash64(*key)))
    edges = checkpoint(patterns_of(mentions).select("m", "kind", "side", F.xxhash64("inst").alias("i"), F.xxhash64("kind", "pattern").alias("p")))
    parts = mentions.filter("size(parts) > 0").select("m", "inst", F.size("parts").alias("of"), F.explode(F.array_distinct("parts")).alias("part"))
    parts = checkpoint(parts)
    sure = mentions.filter("seed").select("m")
    ends = mentions.filter("size(parts) > 0").select("m", F.element_at("parts", 1).alias("first"), F.element_at("parts", -1).alias("last"))
    known = checkpoint(sure)
    # a pattern beside a candidate is borne out by the part of the name that stands next to it
    all_sides = F.explode(F.array(*map(F.lit, "LRB")))
    evidence = checkpoint(sure.select("m", all_sides.alias("side")))
    for _ in range(rounds):
        # patterns by the share of their instances that are known
        marked = edges.join(evidence.withColumn("yes", F.lit(1)), ["m", "side"], "left")
        instances = marked.groupBy("p", "kind", "i").agg(F.max("yes").alias("yes"))
        stats = instances.groupBy("p", "kind").agg(F.count("*").alias("n"), F.count("yes").alias("yes"))
        good = checkpoint(stats.filter((F.col("yes") >= LEAST_KNOWN) & (F.col("yes") >= F.col("n") * share_of(F.col("kind")))).select("p"))
        by_pattern = edges.join(broadcast_if_small(good, 16), "p", "left_semi").select("m").distinct()
        taken = by_pattern.union(sure).distinct()
        # name parts by the share of their mentions that are accepted; a longer run may hold the first word of a sentence
        marked = parts.join(taken.withColumn("yes", F.lit(1)), "m", "left").withColumn("yes", F.when(F.col("of") <= 2, F.col("yes")))
        rates = marked.groupBy("part").agg(F.count("*").alias("n"), F.count("yes").alias("yes"), F.count_distinct(F.when(F.col("yes") == 1, F.col("inst"))).alias("insts"))
        surname = F.col("part").rlike(HAN_START)
        share, least = F.when(surname, SURNAME_SHARE).otherwise(PART_SHARE), F.when(surname, SURNAME_INSTANCES).otherwise(PART_INSTANCES)
        names = checkpoint(rates.filter((F.col("yes") >= F.col("n") * share) & (F.col("insts") >= least)).select("part"))
        held = parts.join(broadcast_if_small(names, 32), "part", "left_semi").groupBy("m").agg(F.count("*").alias("k"), F.first("of").alias("of"))
        # two known parts, or the only part beside initials, make a name; a known Chinese surname is evidence only
        held = checkpoint(held)
        latin = mentions.filter(~F.col("inst").rlike(HAN_START)).select("m")
        known = checkpoint(taken.union(held.filter("k >= 2 or k = of").select("m").join(latin, "m", "left_semi")).distinct())
        left = ends.join(broadcast_if_small(names.withColumnRenamed("part", "first"), 32), "first", "left_semi").select("m")
        right = ends.join(broadcast_if_small(names.withColumnRenamed("part", "last"), 32), "last", "left_semi").select("m")
        borne = left.withColumn("side", F.lit("L")).union(right.withColumn("side", F.lit("R"))).union(left.intersect(right).withColumn("side", F.lit("B")))
        evidence = checkpoint(sure.select("m", all_sides.alias("side")).union(borne).distinct())
    return found.withColumn("m", F.xxhash64(*key)).join(known, "m", "left_semi")


def accepted_mentions(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, kind, start, end, inst, l, r): every mention that the graph of patterns and instances accepts; places are of the canonical text."""
    out = accepted(checkpoint(candidate_table(documents)))
    return out.select("doc_id", "line_no", "kind", F.col("a").alias("start"), F.col("b").alias("end"), "inst", "l", "r").distinct()


def personal_data(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, kind) of every line with a datum of that kind."""
    return accepted(checkpoint(candidate_table(documents))).select("doc_id", "line_no", "kind").distinct()


def offsets(stored: str, known: dict[str, str]) -> tuple[str, list[int], list[int]]:
    """The canonical text, and places of it with the places of the stored text they come from."""
    composing, alone, with_context, _ = tables()
    text = BREAK.sub(" ", stored)
    here, there, out, done = [0], [0], [], 0
    length = 0
    for m in (with_context if composing.search(text) else alone).finditer(text):
        new = canonical(m[0], known)
        out += [text[done : m.start()], new]
        length += m.start() - done
        here.append(length)
        there.append(m.start())
        length += len(new)
        here.append(length)
        there.append(m.end())
        done = m.end()
    out.append(text[done:])
    return "".join(out), here, there


def redacted(documents: DataFrame) -> DataFrame:
    """(doc_id, text): the stored texts with accepted spans replaced by [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] and [NAME]."""
    spans = accepted(checkpoint(candidate_table(documents))).groupBy("doc_id").agg(F.collect_set(F.struct("a", "b", "kind")).alias("spans"))
    docs = documents.select("doc_id", "text").join(spans, "doc_id", "left")
    known: dict[str, str] = {}

    def run(held: pa.Table) -> pa.Table:
        out = []
        for stored, spans in zip(held["text"].to_pylist(), held["spans"].to_pylist()):
            if stored is not None and spans:
                _, here, there = offsets(stored, known)

                def place(x: int, end: bool) -> int:
                    k = (bisect_left(here, x) - 1 if end else bisect_right(here, x) - 1) if x else 0
                    k = max(0, k)
                    step = x - here[k]
                    limit = there[k + 1] - there[k] if k + 1 < len(there) else step
                    return there[k] + min(step, limit) if k % 2 == 0 or not step else there[k + 1]

                done, parts = 0, []
                for s in sorted(spans, key=lambda s: (s["a"], -s["b"])):
                    a, b = place(s["a"], False), place(s["b"], True)
                    if a >= done and b > a:
                        parts += [stored[done:a], f"[{s['kind'].upper()}]"]
                        done = b
                stored = "".join(parts) + stored[done:]
            out.append(stored)
        return pa.table({"doc_id": held["doc_id"], "text": pa.array(out, pa.string())})

    return mapped(docs, run, "doc_id long, text string", 500)
