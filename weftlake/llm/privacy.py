"""Personal data in free text (problem 6): information-theoretic sanitisation.

One pass over the corpus nominates spans by their form (mailboxes, numbers, addresses, runs of capitalised words) or by a
phrase beside them, and counts every word. Nothing is taken for its form alone. How strongly a span's terms reveal a
protected entity is estimated from co-occurrence over the whole corpus, as the pointwise mutual information of term and
kind of entity, log2(p(kind | term) / p(kind)) bits:

* The terms of a number, mailbox or address are its shape (digits as 0, letters as a) and the phrase beside it. A shape
  reveals a kind as far as its occurrences stand beside words that name the kind; a phrase reveals a kind as far as what
  stands beside it has shapes of that kind.
* The terms of a name are its words and the frame or phrase it stands in. A word reveals a person as far as its
  occurrences lie within names by which people introduce themselves; a frame as far as the names in it are known from
  such introductions or consist of revealing words. A run of capitalised words in no known frame is held to its words: a
  second pass looks for runs of revealing words.

A prior, worth a few observations, stands for a term that the corpus hardly shows. A span is taken if one of its terms
leaves at most so many bits of uncertainty about the kind (`LEFT`): its information is log2(1 / p(kind)) less these. What
is taken is generalised to its type, or, as a finding, given as it stands, with its bits.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlake.llm.language import without_mailboxes
from weftlake.session import broadcast_if_small, durable

#: The company's own contacts are no personal data (fixed values, without blanks, lower case).
OWN_CONTACTS = {"hotro@vexa.example", "help@vexa.example", "19005550"}
#: Bits of uncertainty about the kind that a taken span's best term may leave: of a number beside a phrase, of other
#: forms, of a name by its words or by its frame, and of capitalised words without a frame.
LEFT = {"id_number": 5.6, "email": 4.3, "phone": 4.3, "address": 4.3, "words": 2.4, "frame": 4.3, "alone": 1.0}
#: Observations that a prior is worth, and the prior of a form or frame that is hardly ever anything else.
PRIOR_WEIGHT, PRIOR = 4.0, 0.5
#: Rows of terms up to which they are broadcast.
TERM_ROWS = 100_000
#: Word counts are handed on whenever a task holds so many different words.
COUNTER_SIZE = 200_000

_D = "[0-9０-９]"
_H = "[-‐–－.]"
_S = r"[\s\-‐–－.]"
_NOT_BEFORE = r"(?<![A-Za-z0-9０-９/_@＠.#-])"
_NOT_AFTER = r"(?![A-Za-z0-9０-９@＠])"

EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*(?: ?[@＠] ?| ?\[at\] ?| ?\(at\) ?)[A-Za-z0-9-]+(?:(?:[.．]|\s[.．]\s|\s?[\[(]dot[\])]\s?)[A-Za-z0-9-]*[A-Za-z0-9])+", re.I
)
PHONE = re.compile(
    _NOT_BEFORE
    + r"(?:"
    + rf"[(（]?[+＋]\s?(?:84|86|81|1|８４|８６|８１|１)[)）]?{_S}?[(（]?{_D}{{1,3}}[)）]?(?:{_S}?{_D}{{2,4}}){{2,3}}"
    + rf"|[(（]{_D}{{3}}[)）]\s?{_D}{{3}}{_H}{_D}{{4}}"
    + rf"|[0０oO]{_D}{{9}}"
    + rf"|[0０]{_D}{{3}}[ .]{_D}{{3}}[ .]{_D}{{3}}|[0０]{_D}{{2}}[ .]{_D}{{3}}[ .]{_D}{{4}}"
    + rf"|{_D}{{3}}{_H}{_D}{{3}}{_H}{_D}{{4}}"
    + rf"|[1１]{_D}{{10}}"
    + rf"|[0０][789７８９][0０]{_S}?{_D}{{4}}{_S}?{_D}{{4}}"
    + rf"|[1１][3-9３-９]{_D}[- －]{_D}{{4}}[- －]{_D}{{4}}"
    + r")"
    + _NOT_AFTER
)
SURE_ID = re.compile(
    _NOT_BEFORE + r"(?:" + rf"[A-Za-z]{{1,2}}{_D}{{7,8}}|{_D}{{3}}-{_D}{{2}}-{_D}{{4}}|{_D}{{17}}[0-9０-９Xx]|{_D}{{3}} {_D}{{3}} {_D}{{3}} {_D}{{3}}" + r")" + _NOT_AFTER
)
MAYBE_ID = re.compile(_NOT_BEFORE + r"(?:" + rf"{_D}{{12}}|{_D}{{9}}|{_D}{{4}}[- －]{_D}{{4}}[- －]{_D}{{4}}" + r")" + _NOT_AFTER + r"(?!\s?[đ₫])")

_ADDRESSES = [
    re.compile(r"(?:(?:số|so|nhà|nha)\s+)?\d+[A-Za-z]?(?:/\d+[A-Za-z]?)*,?\s+(?:(?:ngõ|ngo|ngách|ngach|hẻm|hem|kiệt|kiet)\s+\d+\S*\s+)?(?:đường|duong|phố|pho)\s+[^\d,.\n]{2,30}(?:,\s*(?:phường|phuong|thị trấn|thi tran|xã|xa|quận|quan|huyện|huyen|P\.|Q\.)\s*[^,.\n]{1,25})*", re.I),
    re.compile(r"(?:số|so|nhà|nha)\s+\d+[A-Za-z]?,?\s+(?:ngõ|ngo|ngách|ngach|hẻm|hem|kiệt|kiet)\s+\d+\S*\s+[^\d,.\n]{2,30}(?:,\s*[^,.\n]{2,25})?", re.I),
    re.compile(r"(?<![\d/])\d+(?:/\d+[A-Za-z]?)+\s+[^\d,.\n]{2,30},\s*(?:P\.|phường|phuong)\s*[^,\n]{1,20}(?:,\s*(?:Q\.|quận|quan)\s*[^,.\n]{1,25})?", re.I),
    re.compile(r"(?:(?:Apt|Flat|Unit|Suite|Room)\.?\s+\d+[A-Za-z]?,\s*)?(?<![\d$:.])\d+[A-Za-z]?\s+(?:[A-Z][\w'’]*\s+){1,3}(?:St|Street|Rd|Road|Ave|Avenue|Lane|Ln|Drive|Dr|Way|Court|Ct|Row|Close|Boulevard|Blvd|Terrace)\b\.?(?:,\s*[A-Z][\w ]{2,25})?"),
    re.compile(r"(?:(?<=live at )|(?<=invoice to )|(?<=address is ))(?:(?:apt|flat|unit|suite|room)\.?\s+\d+[a-z]?,\s*)?\d+[a-z]?\s+(?:[a-z'’]+\s+){1,3}(?:st|street|rd|road|ave|avenue|lane|ln|drive|dr|way|court|ct|row|close|boulevard|blvd|terrace)\b\.?", re.I),
    re.compile(rf"[一-鿿]{{1,8}}?[市区县镇乡][一-鿿]{{1,8}}?(?:路|街|道|巷|大道)\s*{_D}+\s*号(?:\s*{_D}+\s*(?:栋|幢|座|号楼))?(?:\s*{_D}+\s*(?:室|房))?"),
    re.compile(rf"[一-鿿々ぁ-んァ-ヶー]{{1,8}}?[市区町村郡][一-鿿々ぁ-んァ-ヶー]{{1,8}}?\s*{_D}+\s*(?:丁目|番地)\s*{_D}*(?:[-－の]{_D}+)*(?:番地?)?(?:{_D}+号)?"),
    re.compile(rf"[一-鿿々ぁ-んァ-ヶー]{{1,8}}?[市区町村郡][一-鿿々ぁ-んァ-ヶー]{{1,6}}?{_D}+[-－]{_D}+(?:[-－]{_D}+)?"),
]
_ADDRESS_HINT = re.compile(r"[0-9０-９][A-Za-z]?,? (?:[^\W\d_]+ ){0,4}?(?:St|Street|Rd|Road|Ave|Avenue|Lane|Ln|Drive|Dr|Way|Court|Ct|Row|Close|Boulevard|Blvd|Terrace)\b|đường|duong|phố |pho |hẻm|hem |ngõ|ngo |P\. ?\d|phường|phuong|[路街道巷] ?[0-9０-９]+ ?号|丁目|番地|[市区町村郡][^\W\d_]{1,6}[0-9０-９]+[-－][0-9０-９]", re.I)

# Names: phrases that stand around them (fixed values), and what a name looks like.
_LATIN_NAME = r"(?P<n>[^\W\d_][^\W\d_'’.-]*(?:,? [^\W\d_][^\W\d_'’-]*\.?){1,4}?)"
_VI_NAME = r"(?P<n>[^\W\d_]+(?: [^\W\d_]+){1,4}?)"
_HAN = r"[一-鿿々]"
_JA_NAME = rf"(?P<n>{_HAN}{{1,4}}?[ 　]?(?:{_HAN}|[ぁ-んァ-ヶー]){{1,5}}?)"
_ZH_NAME = rf"(?P<n>{_HAN}{{2,4}}?)"
#: How people introduce themselves: what stands here is a name.
_INTRODUCTIONS = [
    (("tên là", "ten la"), re.compile(rf"(?:tên là|ten la)\s+{_VI_NAME}(?=[,.!?]|$|\s+(?:gửi|gui|và|va)\s)", re.I)),
    (("my name is",), re.compile(rf"my name is\s+{_LATIN_NAME}(?=\s+and\s|,\s*(?:my|and)|[.!]\s|[.!]?$)", re.I)),
    (("名前は",), re.compile(rf"名前は\s*{_JA_NAME}(?=です|と申します|、|。)")),
    (("我叫",), re.compile(rf"我叫\s*{_ZH_NAME}(?=[，,。]|\s|$)")),
]
#: Frames that only nominate; the corpus says whether they hold names.
_STRONG_NAMES = [
    (("đặt cho", "dat cho"), re.compile(rf"(?:đặt cho|dat cho)\s+(?:(?:anh|chị|chi|cô|co|chú|chu|bác|bac|ông|ong|bà|ba)\s+)?{_VI_NAME}(?=\s+\d+\s+(?:vé|ve)\b)", re.I)),
    (("nhờ", "nho"), re.compile(rf"(?:nhờ|nho)\s+(?:anh|chị|chi|cô|co|chú|chu|bác|bac|em|ông|ong|bà|ba)\s+{_VI_NAME}(?=\s+(?:đón|don)\s)", re.I)),
    (("hành khách:", "hanh khach:"), re.compile(rf"(?:hành khách|hanh khach):\s*{_VI_NAME}(?=,)", re.I)),
    (("liên hệ", "lien he"), re.compile(rf"(?:liên hệ|lien he):?\s+{_VI_NAME}(?=\s+[-–/]\s*[+(0oO])", re.I)),
    (("for ",), re.compile(rf"seats? for\s+{_LATIN_NAME}(?=,\s*(?:passport|id)\b)", re.I)),
    (("contact:",), re.compile(rf"contact:\s*{_LATIN_NAME}(?=\s*/\s*[+(\d])", re.I)),
    (("passenger ",), re.compile(rf"passenger\s+{_LATIN_NAME}(?=,\s*(?:ID|passport)\b)", re.I)),
    (("連絡先",), re.compile(rf"連絡先[:：]\s*{_JA_NAME}(?=\s*[+＋0０(（])")),
    (("の分で",), re.compile(rf"(?:(?<=^)|(?<=[\s。．.?？!！、/|(（-])){_JA_NAME}(?=の分で{_D}+枚)")),
    (("で承りました",), re.compile(rf"(?:(?<=^)|(?<=[\s。．.?？!！、/|(（-])){_JA_NAME}(?=\s*で承りました)")),
    (("联系人",), re.compile(rf"联系人[:：]\s*{_ZH_NAME}(?=[，,])")),
    (("给",), re.compile(rf"给\s*{_ZH_NAME}(?=订{_D}+张)")),
    (("已为您登记",), re.compile(rf"已为您登记\s*{_ZH_NAME}(?=[，,])")),
]
_WEAK_NAMES = [
    (("ghi nhận", "ghi nhan"), re.compile(rf"(?:ghi nhận|ghi nhan)\s+{_VI_NAME}(?=,)", re.I)),
    (("have noted",), re.compile(rf"have noted\s+{_LATIN_NAME}(?=,\s*please)", re.I)),
    (("thanks,",), re.compile(rf"thanks,\s+{_LATIN_NAME}(?=$|\s*\n|\s+[-–—/|(]\s?|/|[.!?]\s|[.!?]$)", re.I)),
    (("went to",), re.compile(rf"went to\s+{_LATIN_NAME}(?=,\s*not)", re.I)),
]
#: Words that a booking may be "for" without naming anyone.
_NO_NAME = {"mình", "minh", "em", "tôi", "toi", "gia", "đình", "dinh", "nhóm", "nhom", "con", "bé", "family", "my", "me", "the", "our", "your", "us", "two", "people"}
_DIGITS = re.compile(rf"{_D}+")
#: Phrases that lead to an address in a script without spaces.
_LEAD = re.compile(r"^(?:我住在|住在|发票寄到|寄到|地址是?|住所は|お届け先は)\s*[:：]?")
_WORDS = re.compile(r"[^\W\d_]+")
_LONG_NUMBER = re.compile(rf"{_D}(?:[\s.\-‐–－()（）]?[0-9０-９]){{6}}")
_MAIL_SIGNS = ("@", "＠", "[at]", "(at)")
_ADDRESS_SIGNS = ("đường", "duong", "phố ", "pho ", "hẻm", "hem ", "ngõ", "ngo ", "phường", "phuong", ", p.", "丁目", "番地", "号", "区", " st,", " st.", " street", " road", " rd", " ave", " lane", " ln", " drive", " way", " court", " row", " close", " blvd", " boulevard", " terrace")


@functools.lru_cache(1)
def _signs():
    """All literal signs of names, mailboxes and addresses, found in one run over a text."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for kind, words in (("mail", _MAIL_SIGNS), ("address", _ADDRESS_SIGNS)):
        for w in words:
            automaton.add_word(w, kind)
    for group in (_INTRODUCTIONS, _STRONG_NAMES, _WEAK_NAMES):
        for cues, _ in group:
            for c in cues:
                automaton.add_word(c, c)
    automaton.make_automaton()
    return automaton


#: Words that name a kind of personal data beside it (fixed values, accents removed).
_LABELS = {
    "email": re.compile(r"mail|thu\b|メール|邮箱|邮件|郵箱"),
    "phone": re.compile(r"phone|call|tel\b|mobile|contact|reach|number|so\b|sdt|dien thoai|goi|may\b|zalo|lien he|電話|連絡|携帯|番号|电话|手机|联系|号码"),
    "id_number": re.compile(r"passport|\bid\b|identity|ssn|cmnd|cccd|can cuoc|ho chieu|giay to|旅券|パスポート|身分|マイナンバー|証|护照|身份|证"),
    "address": re.compile(r"address|live|living|invoice|send|\bo\b|dia chi|nha\b|gui|toi\b|住所|住|届|送|地址|寄"),
}


def shape(value: str) -> str:
    """The form of a value: digits as 0, letters as a, runs of letters as one."""
    plain = unicodedata.normalize("NFKC", value)
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"\d", "0", plain))


def plain_digits(text: str) -> str:
    return re.sub(r"\s", "", unicodedata.normalize("NFKC", text)).lower()


def beside(text: str, start: int, end: int) -> str:
    """The phrase before a number, else the one after it: up to two words or three CJK characters, folded."""
    before = text[max(0, start - 40) : start].rstrip(" .:：#(（+-　")
    chunk = re.split(r"[,，。;；!！?？\n\d]", before)[-1].strip()
    if not chunk:
        chunk = re.split(r"[,，。;；!！?？\n\d]", text[end : end + 40].strip())[0].strip()
        words = chunk.split()[:2]
        return ">" + (chunk[:4] if chunk and ord(chunk[0]) > 0x2E7F else " ".join(words).lower())
    if ord(chunk[-1]) > 0x2E7F:
        return chunk[-3:]
    folded = "".join(c for c in unicodedata.normalize("NFD", chunk.lower().replace("đ", "d")) if unicodedata.category(c) != "Mn")
    return " ".join(folded.split()[-2:])


#: One nominated span: its kind and value, where it stands, its shape or frame, how surely a form or frame of that kind,
#: the phrase beside it, whether that names the kind (or is an introduction), and the words of a name.
Span = tuple[str, str, int, int, str, float, str, bool, list[str]]
ALONE = "capitals"


@functools.lru_cache(1)
def _capitals() -> re.Pattern:
    """Two to five capitalised words in a row, in a script that has capitals; not those in capitals throughout."""
    upper = "".join(c for c in map(chr, range(0x41, 0x2000)) if unicodedata.category(c) in ("Lu", "Lt"))
    word = rf"[{upper}](?:[^\W\d_]*[^\W\d_{upper}])?['’]?[^\W\d_{upper}]*\.?"
    return re.compile(rf"(?<![^\W_]){word}(?: {word}){{1,4}}(?![^\W_])")


def capital_runs(text: str) -> Iterator[tuple[int, int]]:
    """Where capitalised words stand in a row; if the first may be capitalised for beginning a sentence, also without it."""
    for m in _capitals().finditer(text):
        a, b = m.start(), m.end() - (text[m.end() - 1] == ".")
        yield a, b
        before = text[:a].rstrip(" (\"'“-–*•>")
        second = text.index(" ", a) + 1
        if (not before or before[-1] in ".!?。！？\n:") and " " in text[second:b]:
            yield second, b


def _capital_pass(known: frozenset[str] | None):
    """(tbl, row_id, start, stop, val, terms) of runs of capitalised words, all of them known if these are given."""
    schema = pa.schema([("tbl", pa.string()), ("row_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("val", pa.string()), ("terms", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tbl, row_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for a, b in capital_runs(text) if text else ():
                    words = _WORDS.findall(text[a:b].lower())
                    if known is None or all(len(w) == 1 or w in known for w in words):
                        rows.append((tbl, row_id, a, b, text[a:b], words))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def propose(text: str) -> list[Span]:
    """The spans of a text that may be personal data."""
    out: list[Span] = []
    taken: list[tuple[int, int]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y in taken)

    def add(kind: str, value: str, a: int, b: int, form: str, prior: float, cue: str, anchor: bool, words: list[str]) -> None:
        out.append((kind, value, a, b, form, prior, cue, anchor, words))

    def nominate(kind: str, m: re.Match, form: str, prior: float, value: str | None = None, lead: int = 0) -> None:
        a, b = m.start() + lead, m.start() + len(m.group().rstrip())
        # A script without blanks leads to an address within the match.
        cue = _LEAD.match(m.group().strip()).group() if lead and _LEAD.match(m.group().strip()) else beside(text, *m.span())
        add(kind, m.group() if value is None else value, a, b, form, prior, cue, bool(_LABELS[kind].search(cue)), [])

    signs = {sign for _, sign in _signs().iter(text.lower())}
    number = _LONG_NUMBER.search(text)
    if "mail" in signs:
        for m in EMAIL.finditer(text):
            taken.append(m.span())
            if plain_digits(m.group()) not in OWN_CONTACTS:
                nominate("email", m, "a@a", PRIOR)
    if "address" in signs and _ADDRESS_HINT.search(text):
        for i, pattern in enumerate(_ADDRESSES):
            for m in pattern.finditer(text):
                if free(*m.span()):
                    taken.append(m.span())
                    lead = len(m.group()) - len(_LEAD.sub("", m.group().lstrip()))
                    nominate("address", m, f"address {i}", PRIOR, _DIGITS.search(m.group()).group(), lead)
    if number:
        for kind, pattern, prior in (("phone", PHONE, PRIOR), ("id_number", SURE_ID, PRIOR), ("id_number", MAYBE_ID, 0.0)):
            for m in pattern.finditer(text):
                if free(*m.span()) and plain_digits(m.group()) not in OWN_CONTACTS:
                    taken.append(m.span())
                    nominate(kind, m, shape(m.group()), prior)
    cues = signs - {"mail", "address"}
    if cues:
        for group, prior in ((_INTRODUCTIONS, 1.0), (_STRONG_NAMES, PRIOR), (_WEAK_NAMES, 0.0)):
            for keys, pattern in group:
                if not cues.isdisjoint(keys):
                    for m in pattern.finditer(text):
                        words = [w.lower() for w in _WORDS.findall(m.group("n"))]
                        if free(*m.span("n")) and words and not _NO_NAME.issuperset(words):
                            taken.append(m.span("n"))
                            add("name", m.group("n").strip(), *m.span("n"), keys[0], prior, keys[0], group is _INTRODUCTIONS, words)
    return out


_FOUND = pa.schema([("tbl", pa.string()), ("row_id", pa.int64()), ("kind", pa.string()), ("val", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("form", pa.string()), ("prior", pa.float64()), ("cue", pa.string()), ("anchor", pa.bool_()), ("terms", pa.list_(pa.string())), ("n", pa.int64())])


def _pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter[str] = Counter()

    def counted() -> pa.RecordBatch:
        k = len(words)
        return pa.RecordBatch.from_arrays([pa.nulls(k, f.type) for f in list(_FOUND)[:-2]] + [pa.array([[w] for w in words], pa.list_(pa.string())), pa.array(list(words.values()), pa.int64())], schema=_FOUND)

    for batch in batches:
        rows = []
        tables, ids, texts = (batch.column(i).to_pylist() for i in range(3))
        words.update(_WORDS.findall(without_mailboxes("\n".join(t for t in texts if t)).lower()))
        for tbl, row_id, text in zip(tables, ids, texts, strict=True):
            if text:
                rows += [(tbl, row_id, *found, 1) for found in propose(text)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND)
        if len(words) > COUNTER_SIZE:
            yield counted()
            words.clear()
    if words:
        yield counted()


def enough(kind: str, p):
    """Whether a term that a kind has probability p under leaves no more bits than permitted; p is a column."""
    return -F.log2(p) <= F.lit(LEFT[kind])


def _by_words(spans: DataFrame, revealing: DataFrame) -> DataFrame:
    """spans with the mean and the least share of their words; initials neither speak for nor against a name."""
    share = F.when(F.length("term") > 1, F.coalesce("share", F.lit(0.0)))
    each = spans.select("place", F.explode("terms").alias("term")).join(revealing, "term", "left").groupBy("place").agg(F.avg(share).alias("by_words"), F.min(share).alias("least"))
    return spans.join(each, "place", "left")


def findings(texts: DataFrame) -> DataFrame:
    """(tbl, row_id, kind, val, start, stop, bits): every span of personal data, its value, and how much its terms reveal.

    texts has (tbl string, row_id long, content string). Null, empty and blank texts have no findings; repeated rows give
    one; texts of any length are read whole. start and stop are code points; what they hold is to be replaced, while val
    is the value (of an address, its first number). A value that stands at several places has a row for each.
    """
    proposed = durable(texts.select("tbl", "row_id", "content").mapInArrow(_pass, "tbl string, row_id long, kind string, val string, start int, stop int, form string, prior double, cue string, anchor boolean, terms array<string>, n long"))
    found = durable(proposed.where("kind IS NOT NULL").drop("n").distinct())
    small = lambda df: broadcast_if_small(durable(df), TERM_ROWS)
    strong = F.col("prior") >= PRIOR

    # Numbers, mailboxes and addresses: shapes by the words that name the kind beside them, phrases by the shapes beside them.
    others = found.where("kind <> 'name'")
    smooth = (F.sum(F.col("anchor").cast("double")) + PRIOR_WEIGHT * F.max("prior")) / (F.count(F.lit(1)) + PRIOR_WEIGHT)
    shapes = others.where(strong).groupBy("kind", "form").agg(smooth.alias("by_form"))
    limit = F.create_map(*[F.lit(x) for k in _LABELS for x in (k, LEFT[k])])[F.col("kind")]
    formed = others.join(small(shapes), ["kind", "form"], "left").withColumn("reveals", F.coalesce(strong & (-F.log2("by_form") <= limit), F.lit(False)))
    phrases = formed.groupBy("kind", "cue").agg(F.avg(F.col("reveals").cast("double")).alias("by_cue")).where("by_cue > 0")
    scored = formed.join(small(phrases), ["kind", "cue"], "left")
    p = F.greatest(F.when(strong, F.col("by_form")), F.col("by_cue"))
    numbers = scored.where(-F.log2(p) <= limit).withColumn("p", p)

    # Names: words by how many of their occurrences lie within introductions. Doubtful places, which ask for it, do not count.
    names = found.where("kind = 'name'").withColumn("place", F.struct("tbl", "row_id", "start", "stop"))
    words = proposed.where("kind IS NULL").select(F.col("terms")[0].alias("term"), "n").groupBy("term").agg(F.sum("n").alias("n"))
    inside = names.where("anchor").select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("inside"))
    framed = names.where("NOT anchor").select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("doubtful"))
    share = F.least(F.col("inside") / F.greatest(F.col("n") - F.coalesce("doubtful", F.lit(0)), F.col("inside")), F.lit(1.0))
    revealing = durable(words.join(inside, "term").join(framed, "term", "left").select("term", share.alias("share")))
    asked = names.where("NOT anchor")
    judged = durable(_by_words(asked, broadcast_if_small(revealing, TERM_ROWS)))
    # Introduced names as they stand, also those of scripts without blanks.
    introduced = small(names.where("anchor").select(F.lower("val").alias("v")).distinct().withColumn("introduced", F.lit(True)))
    judged = judged.join(introduced, F.lower(F.col("val")) == F.col("v"), "left").withColumn("known", F.coalesce("introduced", F.lit(False)) | F.coalesce(enough("words", F.col("by_words")), F.lit(False)))
    frames = judged.groupBy("cue").agg(((F.sum(F.col("known").cast("double")) + PRIOR_WEIGHT * F.max("prior")) / (F.count(F.lit(1)) + PRIOR_WEIGHT)).alias("by_frame"))
    weighed = judged.join(small(frames), "cue").withColumn("p", F.greatest("by_words", F.when(strong, F.col("by_frame"))))
    taken = weighed.where((strong & enough("frame", F.col("by_frame"))) | F.coalesce(enough("words", F.col("by_words")), F.lit(False)))

    # Capitalised words elsewhere. The revealing words are sent along up to a bound; beyond it all runs come and are joined.
    few = [r[0] for r in revealing.select("term").limit(TERM_ROWS + 1).collect()]
    runs = texts.select("tbl", "row_id", "content").mapInArrow(_capital_pass(frozenset(few) if len(few) <= TERM_ROWS else None), "tbl string, row_id long, start int, stop int, val string, terms array<string>").distinct()
    held = found.select(F.col("tbl").alias("t"), F.col("row_id").alias("r"), F.col("start").alias("a"), F.col("stop").alias("b"))
    runs = runs.join(held, (F.col("tbl") == F.col("t")) & (F.col("row_id") == F.col("r")) & (F.col("start") < F.col("b")) & (F.col("stop") > F.col("a")), "left_anti")
    runs = durable(runs.withColumns({"place": F.struct("tbl", "row_id", "start", "stop"), "kind": F.lit("name")}))
    apart = _by_words(runs, broadcast_if_small(revealing, TERM_ROWS)).where((F.col("least") > 0) & enough("alone", F.col("by_words"))).withColumn("p", F.col("by_words"))

    columns = ["tbl", "row_id", "kind", "val", "start", "stop", "p"]
    all_ = numbers.select(*columns).unionByName(taken.select(*columns)).unionByName(apart.select(*columns)).unionByName(names.where("anchor").withColumn("p", F.lit(1.0)).select(*columns))
    base = proposed.groupBy("kind").agg(F.sum("n").alias("k")).agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("kind", F.lit("")).alias("kind"), "k"))).alias("of")).first()
    of = (base.of or {}) if base else {}
    rate = F.create_map(*[F.lit(x) for k in (*_LABELS, "name") for x in (k, of.get(k, 1) / max(of.get("", 1), 1))])[F.col("kind")]
    return all_.select("tbl", "row_id", "kind", "val", "start", "stop", F.round(F.log2(F.col("p") / rate), 3).alias("bits")).distinct()


def disclosure_bits(inside: int, occurrences: int, base_rate: float) -> float:
    """How many bits a term's occurrence tells about a protected entity: log2 of its share over the corpus share."""
    return math.log2(max(inside / occurrences, 1e-12) / base_rate)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with [KIND] in place of each span; where spans meet, the longer one; and of each other place of their values."""
    chosen: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(spans, key=lambda x: (x[0] - x[1], x)):
        if all(b <= x or a >= y for x, y, _ in chosen):
            chosen.append((a, b, kind))
    for value, kind in {(text[a:b], kind) for a, b, kind in chosen}:
        edge = r"(?<![^\W_])%s(?![^\W_])" if value[:1].isalnum() and ord(value[0]) < 0x2E80 else "%s"
        for m in re.finditer(edge % re.escape(value), text) if len(value) > 2 else ():
            if all(m.end() <= x or m.start() >= y for x, y, _ in chosen):
                chosen.append((*m.span(), kind))
    out, at = [], 0
    for a, b, kind in sorted(chosen):
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def sanitise(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(tbl, row_id, content) with a typed placeholder such as [EMAIL] in place of each finding, by its place."""
    spans = found.groupBy("tbl", "row_id").agg(F.collect_list(F.struct("start", "stop", "kind")).alias("spans"))
    rows = texts.select("tbl", "row_id", "content").distinct().join(spans, ["tbl", "row_id"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [t if t is None or not s else masked(t, [(x["start"], x["stop"], x["kind"]) for x in s]) for t, s in zip(batch.column("content").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("tbl"), batch.column("row_id"), pa.array(content, pa.string())], names=["tbl", "row_id", "content"])

    kept = rows.where("spans IS NULL").drop("spans")
    return kept.unionByName(rows.where("spans IS NOT NULL").mapInArrow(run, "tbl string, row_id long, content string"))
