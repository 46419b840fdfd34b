"""Surrogates for personal data.

Found in whole texts: e-mail addresses, telephone numbers (international, North American, European national), IPv4
addresses, payment cards (Luhn), IBANs (mod 97), social security numbers, secrets (``token = "..."``) and names (a title and
capitalised words, a known given name and a surname, or Han names with 先生/女士/小姐); once a name is found, its parts are
also replaced where they stand alone in the same document. A name without title, whose given name isn't in the list, isn't found.

Each entity is (kind, normal form): the same digits in another layout, or other capitals, are the same entity
everywhere in the corpus. Its surrogate comes from SHAKE-256 over key, kind, normal form and attempt, of the same type: cards stay
valid with their first digit, IBANs valid in their country, hexadecimal stays hexadecimal, private addresses private; names are
put together from syllables of their script, given names with an ending of their gender, and the text's own layout
and capitals are put back on.

A given name's gender isn't part of the entity: titles all over the corpus vote on it ("Dr Zoe X" and "Mrs Zoe X" are one
Zoe); without a vote the list of given names decides, else the surrogate is neutral. A Cyrillic surname's gender is in its ending.
An e-mail address keeps its domain's identity: the domain is an entity of its own.

Collision check: the distinct entities are gathered once (no texts move). A surrogate that another entity has, or that
is itself an entity of the corpus, is drawn anew with the next attempt; the entity of least normal form
keeps it. What can run out grows: local parts, domains, secrets and names get longer with the attempts, private
addresses take another private range. Fixed formats (cards, social security numbers) that are all in use raise an error with the count
after ATTEMPTS. What needs a later attempt, or whose gender the list doesn't tell, is little, so the texts are rewritten by a map
that holds only those; beyond BROADCAST_ROWS of them they are joined to their documents instead.

Defined results: null and empty texts stay; rows with null doc_id are rewritten too; overlapping finds: the
earliest, then longest; a tie of votes is neutral; repeated rows get the same text; very long texts are searched whole; bytes that
aren't UTF-8 stay as they are; an empty table gives an empty result; all other columns pass through ``rewrite``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, discard, durable, fresh, read
from .wordhash import buffers

#: The key of tests and of these public tables; production gives its own.
KEY = b"sectionwise-surrogates"

_F = {
    "latin": "Mary Anna Emma Laura Sophie Julia Claire Elena Lucia Carmen Sarah Alice Nora Helena Clara Marta Paula Ines Marie Camille Hannah Greta Ingrid Sabine Monika Ursula Karin Isabel Teresa Pilar Rosa Elisa Jessica Jennifer Linda Susan Karen Nancy Emily Olivia Charlotte Amelia Juliette Louise Chloé Hélène Brigitte Heike Petra Silvia",
    "cyrillic": "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия Людмила Галина Вера Надежда Ксения Дарья",
    "greek": "Μαρία Ελένη Αικατερίνη Βασιλική Σοφία Αγγελική Γεωργία Δήμητρα Κωνσταντίνα Ιωάννα",
    "han": "芳 娜 敏 静 丽 艳 娟 霞 秀英 桂英 玉兰 婷 雪梅 淑珍 梦瑶 佳怡",
}
_M = {
    "latin": "John Peter Paul Thomas Martin David Daniel Michael Carlos Jorge Pablo Diego Luis Andrés Jean Pierre Michel Philippe Nicolas Antoine Hans Klaus Jürgen Wolfgang Stefan Markus Uwe Dieter James Robert William Richard Joseph Charles George Edward Henry Oliver Jack Harry Lucas Hugo Arthur Louis Matthias Sebastian Javier Manuel Fernando Rafael",
    "cyrillic": "Иван Пётр Сергей Алексей Дмитрий Андрей Михаил Николай Владимир Александр Павел Юрий Олег Виктор Игорь Борис",
    "greek": "Γεώργιος Δημήτριος Κωνσταντίνος Ιωάννης Νικόλαος Χρήστος Παναγιώτης Βασίλειος Αθανάσιος Μιχαήλ",
    "han": "伟 强 磊 军 勇 杰 涛 明 刚 建国 志强 国华 浩然 子轩 俊杰 文博",
}
_SUR = {
    "latin": "Smith Johnson Brown Taylor Walker Wright Turner Parker Collins Cooper Müller Schmidt Schneider Fischer Weber Becker Hoffmann Schäfer Koch Bauer García Fernández López Martínez Sánchez Pérez Gómez Ruiz Díaz Moreno Dubois Durand Leroy Moreau Lefèvre Girard Bonnet Lambert Fontaine Rousseau Evans Morgan Bennett Foster Hughes Barnes Keller Vogel Lorenz Winter",
    "cyrillic": "Иванов Смирнов Кузнецов Попов Соколов Лебедев Козлов Новиков Морозов Петров Волков Соловьёв Васильев Зайцев Павлов Семёнов",
    "greek": "Παπαδόπουλος Νικολαΐδης Γεωργίου Δημητρίου Βασιλείου Ιωάννου Αντωνίου Χριστοδούλου Οικονόμου Μακρής",
    "han": "王 李 张 刘 陈 杨 黄 赵 吴 周 徐 孙 马 朱 胡 郭 何 林 高 罗",
}
GIVEN = {"F": {k: v.split() for k, v in _F.items()}, "M": {k: v.split() for k, v in _M.items()}}
SURNAMES = {k: v.split() for k, v in _SUR.items()}
_GENDER = {n: g for g in ("F", "M") for names in GIVEN[g].values() for n in names if len(n) >= 3}
_KNOWN = {n.casefold(): g for n, g in _GENDER.items()}
TITLES = {t: g for g, ts in (("M", "Mr Mister Herr Herrn Señor Don Monsieur Господин господин Κύριος"), ("F", "Mrs Ms Miss Frau Señora Señorita Doña Madame Mme Mlle Госпожа госпожа Κυρία"), ("N", "Dr Prof")) for t in ts.split()}
_HAN_TITLES = {"先生": "M", "女士": "F", "小姐": "F"}


def _syllables(onsets: str, vowels: str, codas: str = "") -> list[str]:
    return [o + v + c for o in onsets.split() for v in vowels.split() for c in ["", *codas.split()]]


#: Script -> (first syllables, middle ones, endings by role and gender). Latin alone gives over five million surnames.
PARTS = {
    "latin": (
        _syllables("b br c ch cl d dr f fr g gr h j k kr l m n p pr r s st t tr v w", "a e i o u au", "l n r m s nd rt ld"),
        ["", *_syllables("b d f g h k l m n p r s t v w z th nd ck ll", "a e i o u")],
        {"surname": "son man ton ley field berg mann stein bach feld ez es ard eau ier ini elli etti sen strom ham ford worth well wood by er ing ski ak ic ow ell ott and is".split(), "F": "a ia ina ella ette elle issa ena ana ora lyn ine".split(), "M": "o us ian ert win ric mund ias el in or an".split(), "N": "is y ley en ay ari ey il ou ens ary om".split()},
    ),
    "cyrillic": (
        _syllables("б в г д ж з к л м н п р с т ф х ч", "а е и о у", "р л н с"),
        ["", *(x + y for x in ["", *_syllables("б в д к л м н р с т", "а е и о")] for y in _syllables("б в г д з к л м н п р с т х", "а е и о у"))],
        {"surname": "ов ев ин".split(), "F": "а ия ина ена ела".split(), "M": "ий ан ей ор ен".split(), "N": "ис ель и ени аль".split()},
    ),
    "greek": (
        _syllables("β γ δ ζ θ κ λ μ ν π ρ σ τ φ χ", "α ε ι ο υ", "ρ λ ν"),
        ["", *(x + y for x in ["", *_syllables("β δ κ λ μ ν ρ σ τ", "α ε ι ο")] for y in _syllables("β γ δ κ λ μ ν π ρ σ τ φ", "α ε ι ο υ"))],
        {"surname": "όπουλος ίδης άκης ίου έας".split(), "F": "ία ίνα ούλα ένη".split(), "M": "ος ης ας ων".split(), "N": "ι ω υ ις".split()},
    ),
}
HAN_SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许邓韩冯曹彭曾肖田董潘袁蔡蒋余于杜叶程魏苏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
#: Surrogates take these too; nothing looks for them.
HAN_RARE = "晏柴瞿阎慕连茹习宦艾鱼容古易慎戈庾终暨居衡步都耿满弘匡国文寇广禄阙东殴殳沃利蔚越夔隆师巩厍聂晁勾敖融冷訾辛阚那简饶空曾毋沙乜养鞠须丰巢关蒯相查后荆红游竺权逯盖益桓公仉督岳帅缑亢况郈有琴归海晋楚法汝鄢涂钦商牟佘佴伯赏墨哈谯笪年爱阳佟言福"
HAN_GIVEN = {"F": "芳娜敏静丽艳娟霞秀英桂玉兰婷雪梅淑珍梦瑶佳怡琳颖慧琴燕莉萍欣悦彤诗涵雅菲蓉倩薇", "M": "伟强磊军勇杰涛明刚建国志华浩然子轩俊文博鹏飞宇航晨辉斌峰龙波健松林毅哲睿凯昊"}
HAN_GIVEN["N"] = HAN_GIVEN["F"] + HAN_GIVEN["M"]
ATTEMPTS = 200
_CAP = "[A-ZÀ-ÖØ-ÞΆ-ΏΑ-ΫЀ-Я][\\w'’-]*"
_NAME = re.compile(f"{_CAP}(?:[ ]{_CAP}){{0,2}}")
_TITLE = re.compile(rf"(?<!\w)({'|'.join(sorted(TITLES, key=len, reverse=True))})\.?[ ]+({_CAP}(?:[ ]{_CAP}){{0,2}})")
_PAIR = re.compile(rf"(?<!\w)({'|'.join(sorted((n for n in _GENDER if len(n) >= 4 and '一' > n[0]), key=len, reverse=True))})[ ]({_CAP})")
_HAN = re.compile(f"([{HAN_SURNAMES}])([一-鿿]{{1,2}})({'|'.join(_HAN_TITLES)})")
_IP = re.compile(r"(?<![\w.])(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?!\w|\.\d)")
_CARD = re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w]|[.-]\d)")
_PHONE = re.compile(
    r"(?<![\w+(/.-])(?:(?:\+|00(?=[1-9]))\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|\d{3} \d{3} \d{4}"
    r"|\(0\d{1,4}\)[ ]?\d{3,8}(?:[ -]\d{2,4}){0,2}|0[1-9]\d{0,3}[ /-]\d{5,8}|0[1-9](?:[ .]\d{2}){4}|0[1-9]\d{1,3} \d{3,4} \d{3,4}|[679]\d{2}(?: \d{2}){3}|[67]\d{2} \d{3} \d{3})(?!\w)"
)
_PHONE_WHOLE = re.compile(r"\+(?:1[ .-]?\(?\d{3}\)?|\d{1,3}[ .-]?\(\d{3}\))[ .-]?\d{3}[ .-]?\d{4}(?!\w|[.-]\d)")
_PHONE_END = re.compile(r"(?<=\d)(?=[ .-]\d)")
_SSN = re.compile(r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_SECRET = re.compile(r"[=:]\s{0,3}([\"']?)([A-Za-z0-9_+/=.~-]{8,})(?![\w])")
_SECRET_WORD = re.compile(r"(?:token|api[_ -]?key|secret|password|passwd|pwd|access[_ -]?key|private[_ -]?key|bearer)[\"']?\s{0,3}$", re.IGNORECASE)
_LOCAL = re.compile(r"[\w.%+-]+$")
_DOMAIN = re.compile(r"(?:[^\W_](?:[\w-]{0,61}[^\W_])?\.)+[^\W\d_]{2,24}")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in [*TITLES, *_HAN_TITLES, *(n for n in _GENDER if len(n) >= 4)]:
        a.add_word(w, w)
    a.make_automaton()
    return a


def luhn(d: str) -> bool:
    x = [int(c) for c in reversed(d)]
    return (sum(x[::2]) + sum(sum(divmod(2 * c, 10)) for c in x[1::2])) % 10 == 0


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def script_of(s: str) -> str:
    c = s[0]
    return "han" if "一" <= c <= "鿿" else "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def _name_parts(start: int, s: str, gender: str) -> list[tuple[int, int, str, str, str]]:
    """Parts of a name with the gender that a title gives; the last one is the surname, but for a lone known given name."""
    ws, at, out = s.split(" "), start, []
    for i, w in enumerate(ws):
        core = w.rstrip("'’-")
        core = core[:-2] if core[-2:] in ("'s", "’s") else core
        given = i < len(ws) - 1 or (len(ws) == 1 and core.casefold() in _KNOWN)
        out.append((at, at + len(core), f"{'given' if given else 'surname'}:{script_of(core)}", core.casefold(), gender if given else "N"))
        at += len(w) + 1
    return out


def _local_start(text: str, at: int) -> int:
    """Where the local part that ends at ``at`` begins, however long."""
    reach = 64
    while True:
        lo = max(0, at - reach)
        m = _LOCAL.search(text, lo, at)
        if m is None or m.start() > lo or not lo:
            return m.start() if m else at
        reach *= 4


def find(text: str, digits: bool, at: bool, marks: bool, names: bool) -> list[tuple[int, int, str, str]]:
    """Non-overlapping (start, end, kind, normal form), in order; the flags say what may occur."""
    return [x[:4] for x in find_gendered(text, digits, at, marks, names)]


def find_gendered(text: str, digits: bool, at: bool, marks: bool, names: bool) -> list[tuple[int, int, str, str, str]]:
    """The same with the gender that a title tells: F, M or N."""
    out: list[tuple] = []
    if at:
        i = text.find("@")
        while i >= 0:
            b = _DOMAIN.match(text, i + 1)
            if b:
                start = _local_start(text, i)
                start += len(text[start:i]) - len(text[start:i].lstrip("."))
                if start < i:
                    out.append((start, b.end(), "email", text[start : b.end()].lower()))
            i = text.find("@", i + 1)
    if marks:
        for m in _SECRET.finditer(text):
            if _SECRET_WORD.search(text, max(0, m.start() - 20), m.start()):
                out.append((m.start(2), m.end(2), "secret", m[2]))
    if digits:
        for m in _IP.finditer(text):
            if all(int(x) < 256 for x in m.groups()):
                out.append((m.start(), m.end(), "ip", ".".join(str(int(x)) for x in m.groups())))
        for m in _CARD.finditer(text):
            d = re.sub(r"\D", "", m[0])
            if luhn(d) and len(set(d)) > 1:
                out.append((m.start(), m.end(), "card", d))
        for m in _SSN.finditer(text):
            out.append((m.start(), m.end(), "ssn", m[0].replace("-", "")))
        others = sorted(x[:2] for x in out if x[2] in ("ip", "card", "ssn"))
        m = _PHONE.search(text)
        while m:
            # a complete number of ten national digits, else the longest end of at most 15 digits; before another find if it can be
            end, whole = m.end(), _PHONE_WHOLE.match(text, m.start())
            ends = [whole.end()] if whole else []
            ends += [m.end(), *(m.start() + x.start() for x in reversed(list(_PHONE_END.finditer(m[0]))))]
            ends = [e for e in ends if 8 <= sum(c.isdigit() for c in text[m.start() : e]) <= 15 and _PHONE.fullmatch(text, m.start(), e)]
            if ends:
                stop = next((x for x, e in others if m.start() < x < ends[0]), ends[0])
                end = next((e for e in ends if e <= stop), ends[0])
                d = re.sub(r"\D", "", text[m.start() : end])
                # a national number of ten digits is the same with +1
                out.append((m.start(), end, "phone", d[1:] if m[0][0] == "+" and len(d) == 11 and d[0] == "1" else d))
            m = _PHONE.search(text, end)
        for m in _IBAN.finditer(text):
            s = m[0].replace(" ", "")
            if 15 <= len(s) <= 34 and _mod97(s) == 1:
                out.append((m.start(), m.end(), "iban", s))
    if names:
        parts = []
        for m in _TITLE.finditer(text):
            parts += _name_parts(m.start(2), m[2], TITLES[m[1]])
        for m in _PAIR.finditer(text):
            if m[2] == m[1] or text[max(0, m.start() - len(m[1]) - 1) : m.start()].strip(" ") == m[1]:
                continue  # a repeated word
            parts += _name_parts(m.start(1), m[0], "N")
        for m in _HAN.finditer(text):
            parts += [(m.start(1), m.end(1), "surname:han", m[1], "N"), (m.start(2), m.end(2), "given:han", m[2], _HAN_TITLES[m[3]])]
        if parts:
            known: dict[str, tuple[str, str, str]] = {}
            for s, e, kind, norm, _ in parts:
                if e - s >= 3 and kind[-3:] != "han":
                    known.setdefault(text[s:e], (kind, norm, "N"))
            if known:
                again = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(known, key=len, reverse=True)))})(?!\w)")
                parts += [(m.start(), m.end(), *known[m[0]]) for m in again.finditer(text)]
            out += parts
    out.sort(key=lambda x: (x[0], -x[1], x[2], x[4:] == ("N",)))
    kept, end = [], -1
    for x in out:
        if x[0] >= end:
            kept.append(x if len(x) == 5 else (*x, "N"))
            end = x[1]
    return kept


def _draw(key: bytes, kind: str, norm: str, attempt: int) -> Callable[[int], int]:
    """Draws numbers below n from the keyed stream of one entity."""
    seed = key + b"\0" + f"{kind}\0{norm}\0{attempt}".encode()
    stream, used = b"", 0

    def below(n: int) -> int:
        nonlocal stream, used
        if used + 4 > len(stream):
            stream, used = hashlib.shake_256(seed).digest(max(128, 2 * len(stream))), len(stream)
        used += 4
        return int.from_bytes(stream[used - 4 : used], "little") % n

    return below


def _shaped(s: str, below: Callable[[int], int]) -> str:
    """Letters for letters, digits for digits; lower-case letters so that it can be spoken."""
    hexa = len(s) >= 16 and all(c in "0123456789abcdefABCDEF" for c in s)
    out = []
    for i, c in enumerate(s):
        if hexa:
            d = "0123456789abcdef"[below(16)]
            out.append(d.upper() if s.upper() == s else d)
        elif "0" <= c <= "9":
            out.append(str(below(10)))
        elif c.isalpha():
            d = "aeiou"[below(5)] if i % 2 else "bcdfghklmnprstvz"[below(16)]
            out.append(d.upper() if c.isupper() else d)
        else:
            out.append(c)
    return "".join(out)


def _ip_class(a: list[int]) -> str:
    if a[0] in (10, 127):
        return str(a[0])
    if a[0] == 172 and 16 <= a[1] < 32 or a[:2] in ([192, 168], [169, 254]):
        return f"{a[0]}"
    return "multicast" if 224 <= a[0] < 240 else "reserved" if a[0] >= 240 or a[0] == 0 else "public"


_IP_RANGES = {"10": lambda b: [10, b(256)], "127": lambda b: [127, b(256)], "172": lambda b: [172, 16 + b(16)], "192": lambda b: [192, 168], "169": lambda b: [169, 254], "multicast": lambda b: [224 + b(16), b(256)], "reserved": lambda b: [240 + b(16), b(256)]}


def _ip(a: list[int], attempt: int, below: Callable[[int], int]) -> str:
    kind = _ip_class(a)
    if attempt >= 4 and kind in ("172", "192", "169"):
        kind = "10"  # the range is in use from end to end
    if attempt >= 16:
        kind = "public"
    head = _IP_RANGES[kind](below) if kind != "public" else [0, 0]
    while kind == "public" and _ip_class(head) != "public":
        head = [1 + below(223), below(256)]
    return ".".join(map(str, [*head, below(256), 1 + below(254)]))


def _female(surname: str) -> bool:
    return surname.endswith(("ова", "ева", "ёва", "ина", "ая"))


def _name(role: str, script: str, gender: str, norm: str, attempt: int, below: Callable[[int], int]) -> str:
    if script == "han":
        if role == "surname":
            pool = HAN_SURNAMES + HAN_RARE
            return "".join(pool[below(len(pool))] for _ in range(1 + attempt // 24))
        pool = HAN_GIVEN[gender]
        return "".join(pool[below(len(pool))] for _ in range(len(norm) + attempt // 8))
    first, middle, ends = PARTS[script]
    end = ends["surname" if role == "surname" else gender]
    name = first[below(len(first))] + "".join(middle[below(len(middle))] for _ in range(1 + attempt // 8)) + end[below(len(end))]
    return name + "а" if role == "surname" and script == "cyrillic" and _female(norm) else name


def surrogate(key: bytes, kind: str, norm: str, attempt: int = 0, gender: str = "N") -> str:
    """The normal form of the entity's surrogate; of an e-mail address its local part alone."""
    below = _draw(key, kind, norm, attempt)
    if kind == "email":
        return _shaped(norm.partition("@")[0], below) + "".join("bcdfghklmnprstvz"[below(16)] for _ in range(attempt // 2))
    if kind == "domain":
        labels = norm.split(".")
        labels[:-1] = [_shaped(x, below) for x in labels[:-1]]
        labels[0] += "".join("bcdfghklmnprstvz"[below(16)] for _ in range(attempt // 2))
        return ".".join(labels)
    if kind == "ip":
        return _ip([int(x) for x in norm.split(".")], attempt, below)
    if kind == "card":
        d = norm[0] + "".join(str(below(10)) for _ in norm[2:])
        return next(d + c for c in "0123456789" if luhn(d + c))
    if kind == "ssn":
        return f"{1 + below(665):03d}{1 + below(99):02d}{1 + below(9999):04d}"
    if kind == "phone":
        # a leading 0 and the digit after it stay, unless their numbers are all in use
        keep = max(len(norm) - 10, 0 if norm[0] != "0" or attempt >= 16 else 1 if attempt >= 8 else 2)
        return norm[:keep] + str(2 + below(8)) + "".join(str(below(10)) for _ in norm[keep + 1 :])
    if kind == "iban":
        body = "".join(str(below(10)) if c.isdigit() else chr(65 + below(26)) for c in norm[4:])
        return f"{norm[:2]}{98 - _mod97(norm[:2] + '00' + body):02d}{body}"
    if kind == "secret":
        return _shaped(norm, below) + "".join("bcdfghklmnprstvz"[below(16)] for _ in range(attempt // 2))
    role, script = kind.split(":")
    return _name(role, script, gender, norm, attempt, below)


def default_gender(kind: str, norm: str) -> str:
    return _KNOWN.get(norm, "N") if kind.startswith("given:") else "N"


def render(surface: str, kind: str, new: str) -> str:
    """The surrogate in the layout and capitals of the text."""
    if kind in ("card", "ssn", "phone", "iban"):
        fill = iter(new)
        cells = [i for i, c in enumerate(surface) if c.isalnum()]
        out = list(surface)
        for i in cells[max(0, len(cells) - len(new)) :]:
            out[i] = next(fill)
        return "".join(out)
    if kind == "secret" or kind == "ip":
        return new
    if surface.upper() == surface and surface.lower() != surface and len(surface) > 1:
        return new.upper()
    if kind == "email":
        return new
    return "-".join(w[:1].upper() + w[1:] for w in new.split("-"))


_TRIGGER = np.zeros(256, np.uint8)
_TRIGGER[48:58] = 1
_TRIGGER[64] = 2
_TRIGGER[[58, 61]] = 4


def _scan(texts: pa.Array, names: ahocorasick.Automaton) -> Iterator[tuple[int, str, list]]:
    """(row, text, finds) of the rows that have any. Bytes tell first which rules can apply."""
    data, off = buffers(texts)
    if not len(off) or off[-1] == off[0]:
        return
    kinds = _TRIGGER[data[off[0] : off[-1]]]
    pos = np.flatnonzero(kinds)
    bound = np.searchsorted(pos, off - off[0])
    for r in range(len(off) - 1):
        if off[r + 1] == off[r]:
            continue
        here = kinds[pos[bound[r] : bound[r + 1]]]
        flags = int(np.bitwise_or.reduce(here)) if len(here) else 0
        text = str(data[off[r] : off[r + 1]].tobytes(), "utf-8", "surrogateescape")
        name = next(names.iter(text), None) is not None
        if flags or name:
            found = find_gendered(text, bool(flags & 1), bool(flags & 2), bool(flags & 4), name)
            if found:
                yield r, text, found


def entities(docs: DataFrame) -> DataFrame:
    """Distinct kind, norm of the corpus, and the gender that most titles give (durable)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _automaton()
        for b in batches:
            seen: dict[tuple[str, str], list[int]] = {}
            for _, _, found in _scan(b.column(0), names):
                for *_, kind, norm, g in found:
                    votes = seen.setdefault((kind, norm), [0, 0])
                    if g != "N":
                        votes[g == "M"] += 1
                    if kind == "email":
                        seen.setdefault(("domain", norm.partition("@")[2]), [0, 0])
            cols = [pa.array([k for k, _ in seen], pa.string()), pa.array([n for _, n in seen], pa.string()), *(pa.array([v[i] for v in seen.values()], pa.int64()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(cols, ["kind", "norm", "f", "m"])

    x = docs.select(F.col("text").cast("string").alias("text")).where("text <> ''")
    x = x.mapInArrow(run, "kind string, norm string, f long, m long").groupBy("kind", "norm").agg(F.sum("f").alias("f"), F.sum("m").alias("m"))
    voted = F.when(F.col("f") > F.col("m"), "F").when(F.col("m") > F.col("f"), "M").when(F.col("f") > 0, "N").otherwise("")
    return durable(x.select("kind", "norm", voted.alias("voted")), "pii-entities")


def exceptions(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """kind, norm, attempt, gender of the entities whose first surrogate is taken, or whose gender isn't the list's (durable). found: kind, norm, voted."""

    def candidates(attempt: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                k, n, v = (c.to_pylist() for c in b.columns[:3])
                g = [y or default_gender(*x) for *x, y in zip(k, n, v, strict=True)]
                space = [f"email@{y.partition('@')[2]}" if x == "email" else x for x, y in zip(k, n, strict=True)]
                odd = [y != default_gender(*x) for *x, y in zip(k, n, g, strict=True)]
                new = [surrogate(key, x, y, attempt, z).casefold() for x, y, z in zip(k, n, g, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(g, pa.string()), pa.array(odd, pa.bool_()), pa.array(space, pa.string()), pa.array(new, pa.string())], ["kind", "norm", "voted", "gender", "odd", "space", "new"])

        return run

    # an address can't meet another's: its domain's surrogate is no domain of the corpus
    used = found.where("kind <> 'email'").select(F.col("kind").alias("s_"), F.col("norm").alias("t_"))
    pending, settled, attempt = found.select("kind", "norm", "voted"), None, 0
    while True:
        x = durable(pending.mapInArrow(candidates(attempt), "kind string, norm string, voted string, gender string, odd boolean, space string, new string"), "pii-drawn")
        won = x.groupBy("space", "new").agg(F.min(F.struct("norm", "kind", "voted", "gender", "odd")).alias("m")).select("space", "new", "m.*")
        won = durable(won.join(used, (F.col("space") == F.col("s_")) & (F.col("new") == F.col("t_")), "left_anti"), "pii-won")
        rare = won.where("odd" if not attempt else "true").select("kind", "norm", F.lit(attempt).alias("attempt"), "gender")
        settled = rare if settled is None else settled.union(rare)
        n, m = x.count(), won.count()
        if n == m:
            return durable(settled, "pii-exceptions")
        used = used.union(won.select("space", "new"))
        done = won.select(F.col("kind").alias("k_"), F.col("norm").alias("n_"))
        left = durable(x.select("kind", "norm", "voted").join(done, (F.col("kind") == F.col("k_")) & (F.col("norm") == F.col("n_")), "left_anti"), "pii-pending")
        discard(x, *([pending] if attempt else []))
        pending, attempt = left, attempt + 1
        if attempt >= ATTEMPTS:
            kinds = {r["kind"]: r["count"] for r in pending.groupBy("kind").count().collect()}
            raise ValueError(f"no free surrogate after {ATTEMPTS} attempts: {kinds}")


def rewrite(docs: DataFrame, count_column: str | None = None, key: bytes = KEY, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with surrogates in ``text``; ``count_column`` gets the number of replacements."""
    odd = exceptions(entities(docs), key)
    n_odd = odd.count()
    small = n_odd <= broadcast_rows
    held = docs.sparkSession.sparkContext.broadcast({(r.kind, r.norm): (r.attempt, r.gender) for r in odd.collect()} if small and n_odd else {})
    fix, hash_, kind_, norm_ = fresh(docs, "__odd", "__h", "__k", "__n")
    x = docs
    if not small:

        def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = _automaton()
            for b in batches:
                rows = set()
                for _, t, found in _scan(b.column(0), names):
                    h = hashlib.sha256(t.encode("utf-8", "surrogateescape")).hexdigest()
                    for *_, k, n, _ in found:
                        rows |= {(h, k, n)} | ({(h, "domain", n.partition("@")[2])} if k == "email" else set())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (list(zip(*sorted(rows), strict=True)) or [[]] * 3)], [hash_, kind_, norm_])

        said = docs.select(F.col("text").cast("string").alias("text")).where("text <> ''").mapInArrow(mentions, f"{hash_} string, {kind_} string, {norm_} string").distinct()
        lists = said.join(odd, (F.col("kind") == F.col(kind_)) & (F.col("norm") == F.col(norm_))).groupBy(hash_).agg(F.collect_list(F.struct("kind", "norm", "attempt", "gender")).alias(fix))
        x = docs.join(lists, F.sha2(F.col("text").cast("string"), 256) == F.col(hash_), "left").drop(hash_)
    (count,) = fresh(x, count_column or "__count")
    at = x.columns.index("text")
    schema = T.StructType([*x.schema.fields, T.StructField(count, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, shared = _automaton(), held.value
        for b in batches:
            texts, counts = b.column(at), np.zeros(b.num_rows, np.int32)
            late = None if small else b.column(b.num_columns - 1)
            changed: dict[int, bytes] = {}
            for r, text, found in _scan(texts, names):
                own = shared if late is None else {(v["kind"], v["norm"]): (v["attempt"], v["gender"]) for v in late[r].as_py() or ()}

                def new(kind: str, norm: str) -> str:
                    attempt, gender = own.get((kind, norm)) or (0, default_gender(kind, norm))
                    return surrogate(key, kind, norm, attempt, gender)

                out, end = [], 0
                for s, e, kind, norm, _ in found:
                    to = new(kind, norm)
                    to = f"{to}@{new('domain', norm.partition('@')[2])}" if kind == "email" else to
                    out += [text[end:s], render(text[s:e], kind, to)]
                    end = e
                changed[r] = "".join([*out, text[end:]]).encode("utf-8", "surrogateescape")
                counts[r] = len(found)
            if changed:
                mask = np.zeros(b.num_rows, bool)
                mask[list(changed)] = True
                large = pa.types.is_large_string(texts.type)
                fresh_texts = pa.array([changed[r] for r in sorted(changed)], pa.large_binary() if large else pa.binary()).view(texts.type)
                texts = pa.compute.replace_with_mask(texts, pa.array(mask), fresh_texts)
            cols = [*b.columns, pa.array(counts)]
            cols[at] = texts
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, count])

    out = x.mapInArrow(run, schema)
    out = out if small else out.drop(fix)
    return out if count_column else out.drop(count)


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates, and the number of replacements."""
    return rewrite(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "replaced")
