"""Defective prompt and response pairs (problem 5).

Shortened responses are found by sorting: the sentences of all responses, numbers and names masked, are sorted by text,
and a response's unfinished last sentence is compared with its neighbours' common prefixes. If a finished sentence begins
with it and goes on, it broke off; if it is itself a finished sentence somewhere, or ends as finished sentences do (the
same sort on reversed text), only its stop is missing. That evidence alone decides: spikes in the distribution of response
lengths (`length_limits`) are a report and change no verdict, as a complete answer may have such a length too. Empty, copied and refusing responses follow rules; languages come from the profiles of `language`.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlake.llm import language
from weftlake.session import broadcast_if_small, durable

#: A fragment ends like a finished sentence if so many last characters agree.
END_LATIN, END_CJK = 10, 5
#: Confidence in both languages from which they are said to differ.
SURE = 0.8
#: A length is a limit if such a share of the responses has it, so many times the mean of the lengths around it, half
#: unfinished.
SPIKE_SHARE, SPIKE_TIMES, SPIKE_AROUND = 0.01, 5, 5

# Stand-ins for no answer, and phrases of refusals and of courtesy, accents removed.
STAND_INS = {"null", "none", "nan", "nil", "na", "undefined", "empty", "noanswer", "khongcotraloi", "khongco", "trong", "なし", "無し", "无", "空", "暂无", "tbd", "todo"}
QUOTED = ["banhoi", "cauhoi", "youasked", "yourquestion", "question", "こ質問", "質問", "您问的是", "您的问题", "问题", "您问", "你问"]
REFUSALS = re.compile(
    r"khong the giup|chua co thong tin|khong co thong tin|khong ro chuyen|khong dam tra loi|chua cho (minh|em|toi) xem|ngoai pham vi|khong nhac toi|khong the tra loi|khong tra loi duoc|khong ho tro duoc|tu choi tra loi|(minh|em|toi) khong biet"
    r"|not cover your question|rather not guess|only our team can|(do not|don't|don’t) have any (details|information)|(do not|don't|don’t) know|can(not|'t|’t| not) (help|assist|answer)|unable to (help|assist|answer)|must decline|outside (what|of what|my scope)|no information"
    r"|お答え(でき|いたし)|[分わ]かりかね|分かりません|わかりません|情報がござい|記載がなく|範囲を超え|存じません|ご案内できません|お手伝いできません"
    r"|没有相关信息|超出了|不清楚|帮不了|没有提到|无法(回答|提供|帮)|不知道|不能回答|不便回答"
)
INFORMS_AFTER_ALL = re.compile(r"nhung co the|but (i can|here|you can)|though i can|不过可以|但可以|ますが、次|ただし")
COURTESY = re.compile(
    r"cam on ban da hoi|chao ban|xin loi( ban)?( vi su bat tien)?|rat tiec|tiec la|ban con can gi khac khong|ban (lien he|thu hoi|vui long|co the hoi|goi) [^.]*|moi thac mac.*|can gap ban goi tong dai.*|^da$|^vang$|nhan vien .{0,12}co the biet.*"
    r"|hello( there)?|^hi$|^sure$|^yes$|thanks for asking|sorry( for the trouble)?|apologies|i'm afraid|unfortunately|is there anything else.*|our staff may know more|(please )?(contact|ask|try|reach out to|check with) (the|our|a|customer) .*|for urgent cases call.*"
    r"|お問い合わせありかとうこさいます|^はい$|申し訳こさいません(か)?|すみません|あいにく|こ不便をおかけして|.*お(問い合わせ|尋ね)くたさい|ほかに.*(か|こさいますか)|他に.*か|お急きの方は.*|よろしくお願いします"
    r"|您好|好的|感谢咨询|给您添麻烦了|很抱歉|抱歉|不好意思|请联系.*|您可以(问|咨询|联系).*|还有.*吗|请问还有.*|紧急情况请.*"
)
_SENTENCES = re.compile(r"[^.!?。！？\n]*(?:[.!?](?!\s|$)[^.!?。！？\n]*)*(?:[.!?。！？]+|\n|$)")
_STOPS = ".!?。！？"
_MARKER = re.compile(r"^\s*(?:[-*•>]+\s+|\d+[.)、]\s+|[(（\[\"“「『'`]+)*")
_GREETING = re.compile(r"^(?:Dạ|Chào bạn|Hello|Hi|Sure|Yes|您好|好的|你好|はい)\s*[,，、.]\s*", re.I)
_NAME = re.compile(r"(?<=\S )[^\W\d_a-zà-ỹ][^\W\d_]*(?: [^\W\d_a-zà-ỹ][^\W\d_]*)*")
_NUMBER = re.compile(r"[A-Z]{1,3}-?\d+|\d+")


def _class_of(categories: tuple[str, ...], end: int) -> str:
    """The characters of some categories up to a code point as the inside of a character class, neighbours as ranges."""
    points = [c for c in range(end) if unicodedata.category(chr(c)) in categories]
    starts = [p for i, p in enumerate(points) if i == 0 or points[i - 1] != p - 1]
    ends = [p for i, p in enumerate(points) if i + 1 == len(points) or points[i + 1] != p + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))


# A class without characters beyond the basic plane is looked up at once, one with them range by range.
_MARKS, _ALL_MARKS = (re.compile(f"[{_class_of(('Mn', 'Cf'), end)}]") for end in (0x10000, 0x110000))


def folded(text: str) -> str:
    """Lower case, without accents and marks, compatibility forms resolved."""
    if text.isascii():
        return text.lower()
    plain = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text).lower().replace("đ", "d"))
    return (_MARKS if max(plain, default="") < "\U00010000" else _ALL_MARKS).sub("", plain)


def letters(text: str) -> str:
    """Letters and digits only, folded."""
    return re.sub(r"[\W_]", "", folded(text))


_QUOTED = {letters(x) for x in QUOTED}


def is_empty(answer: str | None) -> bool:
    """Nothing but signs, or a word that stands for nothing."""
    return answer is None or letters(answer) in STAND_INS or not letters(answer)


def is_copy(query: str | None, answer: str) -> bool:
    """The question again, also twice or introduced as a quotation, and nothing else."""
    q, a = letters(query or ""), letters(answer)
    if not q or q not in a:
        return False
    rest = a.replace(q, "")
    return not rest or rest in _QUOTED


def sentences(text: str) -> list[tuple[str, bool]]:
    """(sentence without its stop and list marker, whether it had a stop); line ends end sentences too."""
    out = []
    for m in _SENTENCES.finditer(text):
        raw = m.group().strip()
        body = _MARKER.sub("", raw)
        core = body.rstrip(_STOPS + " ")
        if core:
            out.append((core, body[len(body.rstrip()) - 1 :][:1] in _STOPS or m.group().endswith("\n")))
    return out


def is_refusal(answer: str) -> bool:
    """At least one sentence declines, and no other says anything but courtesies."""
    if not REFUSALS.search(unicodedata.normalize("NFKC", answer).lower()) and not REFUSALS.search(folded(answer)):
        return False
    declines = False
    for s, _ in sentences(answer):
        plain = folded(s)
        if INFORMS_AFTER_ALL.search(plain):
            return False
        if REFUSALS.search(unicodedata.normalize("NFKC", s).lower()) or REFUSALS.search(plain):
            declines = True
            continue
        parts = [p.strip() for p in re.split(r"[,，、;；:：—-]\s*", plain) if re.sub(r"[\W_]", "", p)]
        if any(COURTESY.sub("", p).strip(" .?!？！。") for p in parts) and COURTESY.sub("", plain).strip(" ,，、.?!？！。"):
            return False
    return declines


def masked(sentence: str) -> str:
    """A sentence with numbers and the names inside it replaced."""
    s = _GREETING.sub("", sentence.strip(), count=1)
    s = _NAME.sub("§", _NUMBER.sub("0", s))
    return re.sub(r"\s+", " ", s).strip().lower()


def names_in(sentence: str) -> list[str]:
    """The names inside a sentence, as `masked` finds them."""
    return _NAME.findall(_NUMBER.sub("0", _GREETING.sub("", sentence.strip(), count=1)))


def unfinished(answer: str) -> tuple[str | None, str | None]:
    """(last sentence, masked, if it lacks its stop; the name it ends in); signs, faces and dots after it do not count."""
    text = answer.rstrip()
    while text and text[-1] not in _STOPS and not text[-1].isalnum() and text[-1] not in "%）)」』":
        text = text[:-1].rstrip()
    if not text or text[-1] in _STOPS or (text[-1] in "）)」』" and text[:-1].rstrip()[-1:] in _STOPS):
        return None, None
    found = sentences(text.rstrip("）)」』"))
    if not found:
        return None, None
    rest = masked(found[-1][0])
    names = names_in(found[-1][0])
    return rest or None, (names[-1] if names and rest.endswith("§") else None)


def _parts(profiles: language.Profiles):
    sent = profiles.sent()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = language.Profiles(*sent)
        for batch in batches:
            ids, queries, answers = (batch.column(i).to_pylist() for i in range(3))
            asked, said = language.classify(own, queries), language.classify(own, answers)
            rule, fragment, tail, full, names = [], [], [], [], []
            for q, a, ql, al in zip(queries, answers, asked, said, strict=True):
                if is_empty(a):
                    rule.append("empty")
                elif is_copy(q, a):
                    rule.append("copy")
                elif is_refusal(a):
                    rule.append("refusal")
                elif ql[0] and al[0] and min(ql[1], al[1]) >= SURE and not set(ql[0]) & set(al[0]):
                    rule.append("other_lang")
                else:
                    rule.append(None)
                out = rule[-1] in ("empty", "copy")
                rest, name = (None, None) if out else unfinished(a)
                fragment.append(rest)
                tail.append(name)
                done = [] if out else [s for s, stop in sentences(a) if stop]
                full.append([m for m in map(masked, done) if m])
                names.append([n for s in done for n in names_in(s)])
            texts = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rule, pa.string()), pa.array(fragment, pa.string()), pa.array(tail, pa.string()), pa.array(full, texts), pa.array(names, texts), pa.array([None if a is None else len(a) for a in answers], pa.int64())], names=["id", "rule", "fragment", "tail", "full", "names", "length"])

    return run


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition of (text, whole, fragment, part): each fragment with its finished neighbours in it, and its edges.

    The last row has no text: the first and the last finished text of the partition stand in `after` and `before`.
    """
    first = last = part = None
    waiting: list[tuple[str, bool, str | None]] = []

    def rows(texts, wholes, before, after):
        n = len(texts)
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(wholes, pa.bool_()), pa.array(before, pa.string()), pa.array(after, pa.string()), pa.array([part] * n, pa.int32())], names=["text", "whole", "before", "after", "part"])

    for batch in batches:
        done: list[tuple[str, bool, str | None, str | None]] = []
        for text, whole, fragment, p in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            part = p
            if whole:
                done += [(*w, text) for w in waiting]
                waiting = []
            if fragment:
                waiting.append((text, whole, last))
            if whole:
                first, last = first if first is not None else text, text
        if done:
            yield rows(*zip(*((t, w, b, a) for t, w, b, a in done), strict=True))
    if part is not None:
        if waiting:
            yield rows(*zip(*((t, w, b, None) for t, w, b in waiting), strict=True))
        yield rows([None], [False], [last], [first])


def _neighbours(texts: DataFrame) -> DataFrame:
    """(text, whole, after, before) of every fragment among different texts (text, whole, fragment).

    after and before are the next and the previous finished text in the order of all texts. They are sorted in ranges of
    about equal size, however many begin alike; what lies beyond a range's edge comes from the edges of the others, a row
    each.
    """
    ordered = texts.select("text", "whole", "fragment").repartitionByRange("text").sortWithinPartitions("text").withColumn("part", F.spark_partition_id())
    found = durable(ordered.mapInArrow(_scan, "text string, whole boolean, before string, after string, part int"))
    place = Window.orderBy("part")  # a row per range
    edges = found.where("text IS NULL").select("part", F.last("before", ignorenulls=True).over(place.rowsBetween(Window.unboundedPreceding, -1)).alias("_b"), F.first("after", ignorenulls=True).over(place.rowsBetween(1, Window.unboundedFollowing)).alias("_a"))
    rows = found.where("text IS NOT NULL").join(broadcast_if_small(edges), "part")
    return rows.select("text", "whole", F.coalesce("after", "_a").alias("after"), F.coalesce("before", "_b").alias("before"))


def _tagged(fragments: DataFrame, whole: DataFrame, col: str) -> DataFrame:
    """(text, whole, fragment) of the different values of a column on either side."""
    both = fragments.select(F.col(col).alias("text"), F.lit(False).alias("whole")).unionByName(whole.select(F.col(col).alias("text"), F.lit(True).alias("whole")))
    return both.groupBy("text").agg(F.max("whole").alias("whole"), F.max(~F.col("whole")).alias("fragment"))


def _sorted_evidence(fragments: DataFrame, whole: DataFrame) -> DataFrame:
    """(text, goes_on): whether a finished sentence begins with the fragment and goes on; its next neighbour tells."""
    goes_on = F.coalesce(F.expr("startswith(after, text) AND length(after) > length(text)"), F.lit(False))
    return _neighbours(_tagged(fragments, whole, "text")).select("text", goes_on.alias("goes_on"))


def _ends_alike(fragments: DataFrame, whole: DataFrame) -> DataFrame:
    """(text, ends_alike): whether finished sentences end in the fragment's last characters: the same sort, reversed."""
    cjk = F.col("text").rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]$")
    size = F.when(cjk, F.lit(END_CJK)).otherwise(F.lit(END_LATIN))
    tail = lambda df: df.select("text", F.substring(F.reverse("text"), 1, END_LATIN).alias("tail"), size.alias("size"))
    ends = tail(fragments)
    near = _neighbours(_tagged(ends, tail(whole), "tail")).withColumnRenamed("text", "tail")
    alike = lambda c: F.coalesce(F.expr(f"substring({c}, 1, size) = substring(tail, 1, size)"), F.lit(False))
    return ends.join(near, "tail").select("text", (F.col("whole") | alike("after") | alike("before")).alias("ends_alike"))


def length_limits(parts: DataFrame) -> DataFrame:
    """(length): response lengths that stand out and at which at least half of the responses are unfinished.

    Rows are counted; copies are to be dropped before.
    """
    counts = parts.where("length > 0").groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.count("fragment").alias("open"))
    around = Window.orderBy("length").rangeBetween(-SPIKE_AROUND, SPIKE_AROUND)
    mean = (F.sum("n").over(around) - F.col("n")) / (2 * SPIKE_AROUND)
    total = parts.where("length > 0").agg(F.count(F.lit(1)).alias("total"))
    return counts.withColumn("mean", mean).join(F.broadcast(total), F.lit(True)).where((F.col("n") >= SPIKE_SHARE * F.col("total")) & (F.col("n") > SPIKE_TIMES * F.greatest("mean", F.lit(1))) & (2 * F.col("open") >= F.col("n"))).select("length")


def _read(pairs: DataFrame, id_col: str, query_col: str, answer_col: str, profiles: language.Profiles) -> DataFrame:
    """What each pair shows by itself; exact copies of a row once."""
    id_type = pairs.schema[id_col].dataType.simpleString()
    rows = pairs.select(F.col(id_col).alias("id"), F.col(query_col).alias("q"), F.col(answer_col).alias("a")).dropDuplicates()
    return rows.mapInArrow(_parts(profiles), f"id {id_type}, rule string, fragment string, tail string, full array<string>, names array<string>, length long")


def limits(pairs: DataFrame, id_col: str, query_col: str, answer_col: str, profiles: language.Profiles) -> DataFrame:
    """(length) at which responses were cut off, of all pairs."""
    return length_limits(durable(_read(pairs, id_col, query_col, answer_col, profiles).select("length", "fragment")))


def defects(pairs: DataFrame, id_col: str, query_col: str, answer_col: str, profiles: language.Profiles) -> DataFrame:
    """(id, defect) of every defective pair.

    `empty`, `copy`, `truncated`, `refusal` or `other_lang`: the first that holds. Exact copies of a row count once. A
    null question can only make an answer empty, truncated or a refusal; texts of any length are read whole.
    """
    parts = durable(_read(pairs, id_col, query_col, answer_col, profiles))
    whole = durable(parts.select(F.explode("full").alias("text")).distinct())
    fragments = parts.where("fragment IS NOT NULL").select(F.col("fragment").alias("text")).distinct()
    known = fragments.join(whole.withColumn("known", F.lit(True)), "text", "left").select("text", F.coalesce("known", F.lit(False)).alias("known"))
    evidence = known.join(_sorted_evidence(fragments, whole), "text", "left").join(_ends_alike(fragments, whole), "text", "left")
    cut = ~F.col("known") & (F.coalesce("goes_on", F.lit(False)) | ~F.coalesce("ends_alike", F.lit(False)))
    broken = evidence.where(cut).select(F.col("text").alias("fragment"), F.lit(True).alias("cut"))
    # A fragment that ends in a name which no finished sentence holds broke off within the name.
    known_names = parts.select(F.explode("names").alias("tail")).distinct().withColumn("known_name", F.lit(True))
    judged = parts.drop("full", "names").join(broken, "fragment", "left").join(known_names, "tail", "left")
    half_name = F.col("tail").isNotNull() & F.col("known_name").isNull()
    shortened = F.coalesce("cut", F.lit(False)) | half_name
    defect = F.when(F.col("rule").isin("empty", "copy"), F.col("rule")).when(shortened, "truncated").otherwise(F.col("rule"))
    return judged.select(F.col("id").alias(id_col), defect.alias("defect")).where("defect IS NOT NULL").distinct()
