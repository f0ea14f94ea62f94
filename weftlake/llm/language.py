"""Language of texts and of the segments of mixed texts (problem 4): hyperdimensional n-gram profiles.

Every letter has a random vector of +1 and -1, drawn from its code point alone. An n-gram is bound by multiplying its
letters' vectors, each rotated by its place; a text is the bundle (sum) of its n-grams; a language is the bundle of its
training text. A text is compared with the language prototypes by cosine.

As a bundle is a sum, its product with a prototype is the sum of its n-grams' products. Each worker therefore computes
the product of an n-gram with the prototypes when it first meets the n-gram, and then adds numbers: the result is that of
the full vectors. Texts are handled as one array of code points per batch, without a loop over rows.

Prototypes are fitted on the texts below and on a bounded sample of labelled rows (at most `FIT_ROWS`), whose labels are
checked against the fit before, in a few rounds, as some are wrong.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = ["vi", "en", "ja", "zh"]
#: The prototypes; Vietnamese written without accents has one of its own.
PROFILES = ["vi", "vi_plain", "en", "ja", "zh"]
_LANG_OF = np.array([0, 0, 1, 2, 3])
DIMENSIONS = 8192
#: How much more a single CJK letter weighs in a prototype than a longer n-gram.
LETTER_WEIGHT = 4.0
FIT_ROWS = 8_000
FIT_ROUNDS = 2
#: N-grams whose products a task remembers.
MEMORY = 400_000
#: A language is present in a text from so many letters (CJK: characters) and words on, in units that are clearly its.
LATIN_LETTERS, LATIN_WORDS, CJK_LETTERS = 9, 3, 4
#: How clearly both ends of a Latin unit must differ for it to be split.
SPLIT_AT = 0.5

#: Texts the prototypes begin with.
SEED = {
    "vi": [
        "Xin chào, tôi muốn hỏi về chuyến đi ngày mai, bạn có thể giúp tôi được không?", "Hôm nay trời mưa nên xe sẽ đến trễ hơn bình thường khoảng nửa tiếng.",
        "Cảm ơn bạn đã liên hệ, chúng tôi sẽ trả lời trong thời gian sớm nhất.", "Khách hàng cần mang theo giấy tờ tùy thân khi lên tàu và không được hút thuốc.",
        "Mình đặt vé rồi nhưng chưa nhận được tin nhắn xác nhận, làm sao để kiểm tra?", "Nếu quý khách hủy vé trước giờ khởi hành thì được hoàn lại một phần tiền.",
        "Cho em hỏi giá vé trẻ em là bao nhiêu và có cần mua riêng không ạ?", "Ghế của mình ở tầng dưới, gần cửa sổ, rất thoải mái và sạch sẽ.",
        "Những người đi cùng nhau nên ngồi chung một toa để tiện chăm sóc.", "Không phải ai cũng biết rằng hành lý quá cân phải trả thêm phí.",
    ],
    "en": [
        "Hello, I would like to ask about the trip tomorrow, could you help me with that please?", "It is raining today, so the bus will arrive about half an hour later than usual.",
        "Thank you for contacting us, we will reply as soon as we can.", "Passengers must carry an identity document when they board and smoking is not allowed.",
        "I have booked a ticket but the confirmation message has not arrived, how do I check it?", "If you cancel before departure, part of the money will be returned to your card.",
        "How much is a child ticket and does she need a seat of her own?", "My seat was on the lower deck next to the window, very comfortable and clean.",
        "People who travel together should sit in the same coach.", "Not everyone knows that there is an extra charge for heavy luggage.", "where is my refund", "thanks, that was all I wanted to know",
        "can I pay with a card at the station", "can my child travel alone on the coach", "may I take a small dog with me", "how do I get there", "what does it cost", "who is in charge here",
    ],
    "ja": [
        "こんにちは、明日の旅行についてお聞きしたいのですが、教えていただけますか。", "今日は雨が降っているので、バスはいつもより三十分ほど遅れて到着します。", "お問い合わせいただきありがとうございます。できるだけ早くお返事いたします。",
        "ご乗車の際は身分証明書をお持ちください。車内での喫煙はご遠慮ください。", "切符を予約しましたが、確認のメールが届いていません。どうやって調べればよいですか？", "出発前に取り消された場合は、代金の一部を払い戻します。", "子どもの料金はいくらですか。席は別に必要でしょうか。",
        "座席は窓側で、とても快適できれいでした。", "一緒に旅行する人は同じ車両に座ったほうが便利です。", "荷物が重いと追加の料金がかかることを知らない人もいます。", "払戻手続方法、座席変更可否、発車時刻確認希望、運賃、駅、乗換、手荷物預入、切符購入、領収書発行",
        "連絡先、電話番号、氏名、住所、旅券番号、予約番号", "連絡先", "お名前と住所をお知らせください", "注文番号が見つかりません", "折り返しお電話をお願いします",
    ],
    "zh": [
        "你好，我想问一下明天的行程，您能帮我看看吗？", "今天下雨，所以大巴会比平时晚到半个小时左右。", "感谢您的联系，我们会尽快回复您。", "旅客上车时请带好身份证件，车厢内不能吸烟。", "我已经订了票，但是还没收到确认短信，怎么查询？", "如果您在出发前取消，可以退还一部分钱。",
        "儿童票多少钱，需要单独买座位吗？", "我的座位靠窗，非常舒服也很干净。", "一起出行的人最好坐在同一节车厢。", "不是每个人都知道行李太重要另外收费。", "请问这个怎么弄，钱什么时候能退回来", "为什么扣了两次款，谢谢",
        "联系人、电话、姓名、地址、护照号、订单号", "请打我电话", "同事说还行，我觉得有点贵",
    ],
}

# Classes of characters.
_OTHER, _SPACE, _DIGIT, _LATIN, _CJK, _BREAK, _END = range(7)
_GAP = 0x5F


@functools.lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every code point of the basic plane: class, lower case, whether it is upper case."""
    kind = np.zeros(0x10000, np.uint8)
    low = np.arange(0x10000, dtype=np.uint32)
    up = np.zeros(0x10000, bool)
    for c in range(0x10000):
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat[0] in "LM":
            name = unicodedata.name(ch, "")
            if 0x3040 <= c <= 0x30FF or 0x3400 <= c <= 0x9FFF or 0x3005 <= c <= 0x3007 or 0xF900 <= c <= 0xFAFF or 0x31F0 <= c <= 0x31FF:
                kind[c] = _CJK
            elif name.startswith("LATIN") or cat[0] == "M":
                kind[c] = _LATIN
            else:
                kind[c] = _OTHER
        elif cat[0] == "N":
            kind[c] = _DIGIT
        elif ch == "\0":
            kind[c] = _END
        elif cat == "Zs" or ch == "\t":
            kind[c] = _SPACE
        elif cat[0] == "P" and ch not in "'’-_@&%*·・" or ch in "\n\r|=+~":
            kind[c] = _BREAK
        lower = ch.lower()
        if len(lower) == 1:
            low[c] = ord(lower)
            up[c] = lower != ch
    return kind, low, up


def plain_latin(text: str) -> str:
    """Without accents, đ as d."""
    return "".join(c for c in unicodedata.normalize("NFD", text.replace("đ", "d").replace("Đ", "D")) if unicodedata.category(c) != "Mn")


_AT = re.compile(r" ?(?:[@＠]|\[at\]|\(at\)) ?")
_DOMAIN = re.compile(r"[A-Za-z0-9-]*(?: ?(?:\(dot\)|\.) ?[A-Za-z0-9-]+)*")


def without_mailboxes(text: str) -> str:
    """A text without mailboxes and their domains: they say nothing about its language, nor what words stand for."""
    parts, last = [], 0
    for m in _AT.finditer(text):
        a = m.start()
        while a > last and text[a - 1].isascii() and (text[a - 1].isalnum() or text[a - 1] in "._+-"):
            a -= 1
        b = _DOMAIN.match(text, m.end()).end()
        if a >= last:
            parts.append(text[last:a])
            last = b
    parts.append(text[last:])
    return " ".join(parts)


class Units:
    """The units of a batch of texts: stretches of one script between signs, as grams with the unit they belong to."""

    def __init__(self, texts: list[str | None]) -> None:
        kind, low, up = _tables()
        joined = unicodedata.normalize("NFKC", "\0".join((t or "").replace("\0", " ") for t in texts) + "\0")
        if "@" in joined or "[at]" in joined or "(at)" in joined:
            joined = without_mailboxes(joined)
        cps = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        # Han letters beyond the basic plane stand as one rare letter of it; what else is there belongs to no language.
        cps = np.where(cps < 0x10000, cps, np.where((cps >= 0x20000) & (cps < 0x40000), 0x4DB5, 0x1F)).astype(np.uint32)
        k = kind[cps]
        # A stop inside a word or number, or after an initial, ends nothing.
        stops = np.flatnonzero(cps == 0x2E)
        stops = stops[(stops > 1) & (stops < len(cps) - 1)]
        solid = np.isin(k[stops - 1], [_LATIN, _DIGIT]) & np.isin(k[stops + 1], [_LATIN, _DIGIT])
        initial = up[cps[stops - 1]] & (k[stops - 2] == _SPACE)
        k[stops[solid | initial]] = _OTHER
        self.n = len(texts)
        text_of = np.concatenate([[0], np.cumsum(k == _END)[:-1]])
        letter = (k == _LATIN) | (k == _CJK)
        # Latin words: where each begins; a word with a capital that follows another word is a name, unless it has more.
        latin = k == _LATIN
        before = np.concatenate([[False], latin[:-1]])
        begins = latin & ~before
        word = np.cumsum(begins) - 1
        at = np.flatnonzero(begins)
        name = np.zeros(len(at), bool)
        if len(at):
            capital = up[cps[at]]
            nxt = np.minimum(at + 1, len(cps) - 1)
            shout = latin[nxt] & up[cps[nxt]]
            prev = np.maximum(at - 1, 0)
            # what stands before the white space before the word
            last = np.maximum.accumulate(np.where(k != _SPACE, np.arange(len(k)), 0))
            lead = k[last[prev]]
            first = (at == 0) | (lead == _BREAK) | (lead == _END) | (lead == _CJK)
            name = capital & ~shout & ~first
            # parts of codes and addresses: words touched by digits or @
            touched = np.isin(cps[prev], [0x40, 0x5F, 0x26]) & (at > 0)
            end = np.concatenate([np.flatnonzero(latin & ~np.concatenate([latin[1:], [False]])), []]).astype(np.int64)
            follow = np.minimum(end + 1, len(cps) - 1)
            touched |= (k[prev] == _DIGIT) & (at > 0) | (k[follow] == _DIGIT) | np.isin(cps[follow], [0x40, 0x5F])
            name |= touched
            letter = letter & ~(latin & name[np.maximum(word, 0)])
        # Units change at breaks, at the end of a text and where the script of letters changes.
        where = np.flatnonzero(letter)
        script = k[where]
        parts = np.cumsum((k == _BREAK) | (k == _END))
        if len(where):
            change = np.concatenate([[True], (script[1:] != script[:-1]) | (parts[where[1:]] != parts[where[:-1]])])
        else:
            change = np.zeros(0, bool)
        self.word_begin = np.concatenate([[True], where[1:] != where[:-1] + 1]) if len(where) else np.zeros(0, bool)
        self.joined, self.where, self.script, self.text_of_letter, self.chars = joined, where, script, text_of[where], low[cps[where]]
        self._index(change)

    def _index(self, change: np.ndarray) -> None:
        """Everything that depends on where units begin."""
        self.change = change
        unit = np.cumsum(change) - 1
        self.count = int(unit[-1]) + 1 if len(unit) else 0
        first_at = np.flatnonzero(change)
        self.text = self.text_of_letter[first_at]
        self.cjk = self.script[first_at] == _CJK
        self.letters = np.bincount(unit, minlength=self.count)
        self.words = np.bincount(unit[self.word_begin], minlength=self.count)
        self.start = self.where[first_at]
        last_at = np.concatenate([first_at[1:], [len(unit)]]).astype(np.int64) - 1 if self.count else first_at
        self.stop = self.where[last_at] + 1
        # Letters with a gap before each Latin word.
        gap = self.word_begin & (self.script == _LATIN)
        size = 1 + gap.astype(np.int64)
        pos = np.cumsum(size) - 1
        seq = np.full(int(size.sum()), _GAP, np.uint64)
        seq[pos] = self.chars
        owner = np.zeros(len(seq), np.int64)
        owner[pos] = unit
        owner[pos[gap] - 1] = unit[gap]
        self.seq, self.owner = seq, owner
        self.gaps, self.gap_letter = pos[gap] - 1, np.flatnonzero(gap)

    def split(self, profiles: Profiles) -> None:
        """Latin units whose first words are clearly of one language and whose last ones clearly of another become two."""
        s, o = self.seq, self.owner
        if len(s) < 3 or not len(self.gaps):
            return
        long = (~self.cjk) & (self.words >= 2 * LATIN_WORDS)
        if not long.any():
            return
        at = np.flatnonzero((o[2:] == o[:-2]) & long[o[2:]]) + 2
        v = profiles.products(s[at - 2] << np.uint64(42) | s[at - 1] << np.uint64(21) | s[at]) / np.sqrt(DIMENSIONS)
        d = np.zeros(len(s))
        d[at] = v[:, 2] - np.maximum(v[:, 0], v[:, 1])
        total = np.bincount(o, weights=d, minlength=self.count)
        run = np.cumsum(d)
        first = np.searchsorted(o, np.arange(self.count))
        base = run[first] - d[first]
        g = self.gaps[long[o[self.gaps]]]
        if not len(g):
            return
        u = o[g]
        left = run[g] - base[u]
        right = total[u] - left
        contrast = np.where(left * right < 0, np.minimum(np.abs(left), np.abs(right)), 0)
        number = np.arange(len(g)) - np.searchsorted(u, u)  # words before the gap
        fits = (number >= LATIN_WORDS) & (self.words[u] - number >= LATIN_WORDS)
        contrast = np.where(fits, contrast, 0)
        best = np.zeros(self.count)
        np.maximum.at(best, u, contrast)
        cut = (contrast >= SPLIT_AT) & (contrast == best[u])
        if cut.any():
            change = self.change.copy()
            change[self.gap_letter[np.searchsorted(self.gaps, g[cut])]] = True
            self._index(change)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """(codes, unit of each): trigrams of all, bigrams and single letters of CJK units."""
        s, o = self.seq, self.owner
        codes, owners = [], []
        if len(s) >= 3:
            ok = o[2:] == o[:-2]
            codes.append((s[:-2] << np.uint64(42) | s[1:-1] << np.uint64(21) | s[2:])[ok])
            owners.append(o[2:][ok])
        if len(s) >= 2:
            ok = (o[1:] == o[:-1]) & self.cjk[o[1:]]
            codes.append((s[:-1] << np.uint64(21) | s[1:])[ok])
            owners.append(o[1:][ok])
        if len(s):
            ok = self.cjk[o]
            codes.append(s[ok])
            owners.append(o[ok])
        return (np.concatenate(codes), np.concatenate(owners)) if codes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


@functools.lru_cache(6000)
def _letter(code: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(code + 0x5EED)).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1


@functools.lru_cache(8000)
def _rotated(code: int, by: int) -> np.ndarray:
    return np.roll(_letter(code), by)


def gram_vector(code: int) -> np.ndarray:
    """The bound vector of an n-gram code."""
    a, b, c = code >> 42, (code >> 21) & 0x1FFFFF, code & 0x1FFFFF
    v = _letter(c)
    if b:
        v = v * _rotated(b, 1)
    if a:
        v = v * _rotated(a, 2)
    return v


class Profiles:
    """Language prototypes, and the memory of the products of n-grams with them.

    The memory is bounded: with more than `MEMORY` n-grams a task begins again from those it was sent.
    """

    def __init__(self, matrix: np.ndarray, known: np.ndarray | None = None, values: np.ndarray | None = None) -> None:
        self.matrix = matrix  # languages x dimensions, centred and of unit length
        self.known = np.zeros(0, np.uint64) if known is None else known
        self.values = np.zeros((0, len(PROFILES)), np.float32) if values is None else values
        self.first = self.known, self.values

    def sent(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What tasks need: the prototypes, and the products of the n-grams of the bounded fitting sample."""
        return self.matrix, self.known, self.values

    def products(self, codes: np.ndarray) -> np.ndarray:
        """Of each n-gram with each prototype."""
        if not len(codes):
            return np.zeros((0, len(PROFILES)), np.float32)
        at = np.minimum(np.searchsorted(self.known, codes), max(len(self.known) - 1, 0))
        fresh = self.known[at] != codes if len(self.known) else np.ones(len(codes), bool)
        if fresh.any():
            new = np.unique(codes[fresh])
            values = np.concatenate([np.stack([gram_vector(int(c)) for c in new[i : i + 512]]).astype(np.float32) @ self.matrix.T for i in range(0, len(new), 512)])
            if len(self.known) + len(new) > MEMORY:
                self.known, self.values = self.first
                new = np.unique(codes[~np.isin(codes, self.known)])
                values = np.concatenate([np.stack([gram_vector(int(c)) for c in new[i : i + 512]]).astype(np.float32) @ self.matrix.T for i in range(0, len(new), 512)])
            place = np.searchsorted(self.known, new)
            self.known, self.values = np.insert(self.known, place, new), np.insert(self.values, place, values, axis=0)
            at = np.searchsorted(self.known, codes)
        return self.values[at]

    def cosines(self, units: Units) -> np.ndarray:
        """Units x profiles: the cosine of a unit's bundle and each prototype.

        The bundle's length is taken as its expectation, that of as many orthogonal n-grams: random vectors of so many
        dimensions are orthogonal but for about one part in 90, and few n-grams of a unit repeat.
        """
        codes, owner = units.grams()
        p = self.products(codes)
        sums = np.stack([np.bincount(owner, weights=p[:, i], minlength=units.count) for i in range(len(PROFILES))], axis=1) if units.count else np.zeros((0, len(PROFILES)))
        n = np.maximum(np.bincount(owner, minlength=units.count), 1)
        return sums / np.sqrt(n * DIMENSIONS)[:, None]


def fit(texts_by_profile: dict[str, list[str]]) -> Profiles:
    """Prototypes of training texts: bundles of weighted n-grams."""
    bundles = []
    for profile in PROFILES:
        codes, _ = Units(texts_by_profile[profile]).grams()
        grams, counts = np.unique(codes, return_counts=True)
        bundle = np.zeros(DIMENSIONS, np.float64)
        # Counts are damped, so that what is rare is heard over the noise of what is frequent; single letters weigh more, as
        # in a script of many letters they tell most.
        weights = (1 + np.log(counts)) * np.where(grams < 1 << 21, LETTER_WEIGHT, 1.0)
        for i in range(0, len(grams), 512):
            bundle += weights[i : i + 512] @ np.stack([gram_vector(int(c)) for c in grams[i : i + 512]]).astype(np.float64)
        bundles.append(bundle / max(np.linalg.norm(bundle), 1e-9))
    m = np.stack(bundles)
    m = m - m.mean(axis=0)
    return Profiles((m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32))


@functools.lru_cache(1)
def letters_of_one_script() -> dict[str, str]:
    """Common Han letters that only Chinese or only Japanese national character sets have, each a text of its own."""
    han = [chr(c) for c in range(0x4E00, 0x9FA6)]

    def code(ch: str, codec: str) -> bytes:
        try:
            return ch.encode(codec)
        except UnicodeEncodeError:
            return b""

    zh, ja = [], []
    for ch in han:
        g, j = code(ch, "gb2312"), code(ch, "shift_jis")
        if g and not j and g[0] < 0xD8:  # the set's first level holds what is common
            zh.append(ch)
        elif j and not g and j < b"\x98\x9f":
            ja.append(ch)
    return {"zh": "。".join(zh), "ja": "。".join(ja)}


def _training(pairs: list[tuple[str, str]]) -> dict[str, list[str]]:
    out = {p: list(SEED.get(p, [])) * 3 + [letters_of_one_script().get(p, "")] * 3 for p in PROFILES}
    for text, lang in pairs:
        if lang == "vi" and text.isascii():
            out["vi_plain"].append(text)
        elif lang in out:
            out[lang].append(text)
    out["vi_plain"] += [plain_latin(t) for t in out["vi"]]
    return out


def labelled_sample(labelled: DataFrame, text_col: str, lang_col: str, rows: int = FIT_ROWS) -> list[tuple[str, str]]:
    """(text, label) of at most `rows` different labelled texts, as many of each of the four labels, lowest hashes first.

    The same for any order and partitioning of the rows. A threshold on the hash, from the number of different texts,
    keeps what leaves the tasks near the bound, whatever the size of the table and however often a text is repeated.
    """
    base = labelled.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where(F.col("l").isin(LANGUAGES) & F.col("t").isNotNull()).withColumn("h", F.xxhash64("t"))
    quota = max(rows // len(LANGUAGES), 1)
    low = F.lit(False)
    for r in base.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).collect():
        share = min(1.0, 1.5 * quota / max(r.n, 1))
        low = low | ((F.col("l") == r.l) & (F.col("h") <= F.lit(min(int(share * 2**64), 2**64 - 1) - 2**63)))
    out: dict[str, list] = {x: [] for x in LANGUAGES}
    for r in sorted(base.where(low).distinct().collect(), key=lambda r: (r.h, r.t)):
        if len(out[r.l]) < quota:
            out[r.l].append((r.t, r.l))
    return [pair for x in LANGUAGES for pair in out[x]]


def fit_on_sample(labelled: DataFrame, text_col: str, lang_col: str, rows: int = FIT_ROWS) -> Profiles:
    """Prototypes of the seed texts and of at most `rows` rows with one of the four labels."""
    sample = labelled_sample(labelled, text_col, lang_col, rows)
    texts, labels = [t for t, _ in sample], [x for _, x in sample]
    profiles = fit(_training([]))
    for _ in range(FIT_ROUNDS):
        said = classify(profiles, texts)
        # Rows in doubt, mixed ones and those whose label the fit before contradicts do not train.
        profiles = fit(_training([(t, label) for t, label, s in zip(texts, labels, said, strict=True) if s[0] == [label]]))
    classify(profiles, texts)  # so that tasks need not begin without any n-gram
    return profiles


def judge_units(profiles: Profiles, texts: list[str | None]) -> tuple[Units, np.ndarray, np.ndarray, np.ndarray]:
    """(units, language of each, confidence of each, language scores)."""
    units = Units(texts)
    units.split(profiles)
    cos = profiles.cosines(units)
    by_lang = np.stack([np.maximum(cos[:, 0], cos[:, 1]), cos[:, 2], cos[:, 3], cos[:, 4]], axis=1) if units.count else np.zeros((0, 4))
    # Latin letters are not Japanese or Chinese, and the other way round.
    by_lang = np.where(units.cjk[:, None] == np.array([False, False, True, True]), by_lang, -1.0) if units.count else by_lang
    best = by_lang.argmax(axis=1) if units.count else np.zeros(0, int)
    top = np.sort(by_lang, axis=1)
    margin = (top[:, -1] - top[:, -2]) * np.sqrt(np.maximum(units.letters, 1)) if units.count else np.zeros(0)
    return units, best, 1 / (1 + np.exp(-12 * margin)), by_lang


def presence(units: Units, best: np.ndarray, confidence: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: (main language or -1, which languages it holds at least a clause of, confidence of the main one)."""
    n = units.n
    weight = np.zeros((n, 4))
    summed = np.zeros((n, 4))
    letters = np.zeros((n, 2))
    for lang in range(4):
        latin = lang < 2
        mine = best == lang
        clear = mine & (confidence > 0.75)
        size = np.where(units.cjk, units.letters, units.letters)
        enough = clear & (np.where(units.cjk, units.letters >= CJK_LETTERS, (units.letters >= LATIN_LETTERS) & (units.words >= LATIN_WORDS)))
        weight[:, lang] = np.bincount(units.text[enough], weights=size[enough], minlength=n)
        summed[:, lang] = np.bincount(units.text, weights=np.where((units.cjk != latin), scores[:, lang] * np.sqrt(np.maximum(units.letters, 1)), 0), minlength=n) if units.count else 0
    if units.count:
        letters[:, 0] = np.bincount(units.text[~units.cjk], weights=units.letters[~units.cjk], minlength=n)
        # A CJK character says about as much as three Latin letters.
        letters[:, 1] = 3 * np.bincount(units.text[units.cjk], weights=units.letters[units.cjk], minlength=n)
    cjk = letters[:, 1] >= letters[:, 0]
    main = np.where(cjk, 2 + summed[:, 2:].argmax(axis=1), summed[:, :2].argmax(axis=1))
    pair = np.where(cjk[:, None], summed[:, 2:], summed[:, :2])
    sure = 1 / (1 + np.exp(-12 * np.abs(pair[:, 0] - pair[:, 1])))
    main = np.where(letters.max(axis=1) >= 3, main, -1)
    present = weight > 0
    return main, present, sure


#: Single words that belong to no language.
NEUTRAL = {"ok", "okay", "oke", "okie", "vip", "wifi", "qr", "pdf", "sms", "otp", "email", "id", "app", "vs"}


def is_neutral(text: str | None) -> bool:
    return text is not None and len(text) < 12 and set(text.lower().split()) <= NEUTRAL


def classify(profiles: Profiles, texts: list[str | None]) -> list[tuple[list[str], float]]:
    """(languages, confidence) of each text: none, one, or several if it is mixed."""
    units, best, confidence, scores = judge_units(profiles, texts)
    main, present, sure = presence(units, best, confidence, scores)
    out = []
    for i, t in enumerate(texts):
        if main[i] < 0 or is_neutral(t):
            out.append(([], 0.0))
        elif present[i].sum() > 1:
            out.append(([LANGUAGES[j] for j in np.flatnonzero(present[i])], float(sure[i])))
        else:
            out.append(([LANGUAGES[main[i]]], float(sure[i])))
    return out


def detect(df: DataFrame, id_col: str, text_col: str, profiles: Profiles) -> DataFrame:
    """(id, languages array<string>, mixed boolean, confidence double) of every row, in one pass without a shuffle.

    Null, empty and blank texts, and texts without words of a language, get an empty array and confidence 0.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    sent = profiles.sent()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Profiles(*sent)
        for batch in batches:
            found = classify(own, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.list_(pa.string())), pa.array([len(f[0]) > 1 for f in found]), pa.array([f[1] for f in found], pa.float64())], names=["id", "languages", "mixed", "confidence"])

    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, languages array<string>, mixed boolean, confidence double").withColumnRenamed("id", id_col)


def segment(df: DataFrame, id_col: str, text_col: str, profiles: Profiles) -> DataFrame:
    """(id, segment, lang, confidence, content): the stretches of one language of every text, in order from 0."""
    id_type = df.schema[id_col].dataType.simpleString()
    sent = profiles.sent()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Profiles(*sent)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            units, best, confidence, scores = judge_units(own, texts)
            main, present, _ = presence(units, best, confidence, scores)
            rows = []
            for u in range(units.count):
                t = int(units.text[u])
                # A unit too short to be a clause goes with what stands before it.
                clause = units.letters[u] >= (CJK_LETTERS if units.cjk[u] else LATIN_LETTERS) and (units.cjk[u] or units.words[u] >= LATIN_WORDS)
                lang = int(best[u]) if clause and present[t].sum() > 1 else (rows[-1][1] if rows and rows[-1][0] == t else int(main[t]) if main[t] >= 0 else -1)
                if lang < 0 or is_neutral(texts[t]):
                    continue
                if rows and rows[-1][0] == t and rows[-1][1] == lang:
                    rows[-1][3] = int(units.stop[u])
                    rows[-1][4].append((float(confidence[u]), int(units.letters[u])))
                else:
                    rows.append([t, lang, int(units.start[u]), int(units.stop[u]), [(float(confidence[u]), int(units.letters[u]))]])
            out, number = [], {}
            for t, lang, start, stop, conf in rows:
                number[t] = number.get(t, -1) + 1
                out.append((ids[t], number[t], LANGUAGES[lang], sum(c * n for c, n in conf) / max(sum(n for _, n in conf), 1), units.joined[start:stop]))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.string())], names=["id", "segment", "lang", "confidence", "content"])

    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, segment int, lang string, confidence double, content string").withColumnRenamed("id", id_col)
