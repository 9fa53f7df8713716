"""Personal information in free text: find it and put typed placeholders in its place.

Broad patterns propose spans of four families (mail addresses, numbers, street addresses, names). Labelers vote on every span: regular expressions on its form,
gazetteers on its words, context words around it. No labeler is trusted: expectation-maximisation over the counts of vote patterns estimates how
reliable each one is (a confusion matrix) and how likely each class is per pattern. These soft labels train a span classifier on votes, form and
neighbouring words, whose decisions are the result. Learned: all reliabilities, priors and weights. Fixed: the word lists and patterns below.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake.staging import stage

#: Classes; 0 is none. Placeholders of the redacted text.
KINDS = ("none", "phone", "email", "identity", "address", "name")
PLACEHOLDERS = {"phone": "[PHONE]", "email": "[EMAIL]", "identity": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}
ABSTAIN, NONE, PHONE, EMAIL, IDENTITY, ADDRESS, NAME = -1, 0, 1, 2, 3, 4, 5
FAMILIES = ("mail", "number", "street", "person")

#: Gazetteers and context words.
FIRST_NAMES = """
Александр Алексей Анатолий Андрей Антон Аркадий Артём Артур Богдан Борис Вадим Валентин Валерий Василий Виктор Виталий Владимир Владислав Вячеслав
Геннадий Георгий Герман Глеб Григорий Давид Даниил Денис Дмитрий Евгений Егор Захар Иван Игорь Илья Кирилл Константин Лев Леонид Макар Максим Марат Марк Матвей Михаил
Никита Николай Олег Павел Пётр Роман Руслан Савелий Семён Сергей Станислав Степан Тимофей Тимур Фёдор Филипп Эдуард Юрий Яков Ярослав
Алина Алёна Алиса Алла Анастасия Ангелина Анна Валентина Валерия Варвара Василиса Вера Вероника Виктория Галина Дарья Диана Ева Евгения Екатерина Елена Елизавета Жанна Зинаида Зоя
Инна Ирина Карина Кира Кристина Ксения Лариса Лидия Лилия Любовь Людмила Маргарита Марина Мария Надежда Наталья Наталия Нина Оксана Ольга Полина Раиса Светлана София Софья Таисия Тамара Татьяна
Ульяна Юлия Яна
""".split()
LATIN_NAMES = """
Adam Alan Alexander Alice Andrew Anna Anton Arthur Boris Charles Clara Daniel David Denis Edgar Edward Elena Emily Emma Eric Eva Frank George Grace Hannah Harry Helen Henry Igor Irina Ivan
Jack James Jane John Julia Kate Laura Lena Lenora Leonard Linda Lisa Lucas Lucy Maria Marina Mark Martin Mary Max Michael Nadia Nina Oleg Olga Oliver Oscar Paul Peter Petr Philip Richard Robert Roman
Sarah Simon Sofia Sophie Stephan Thomas Vera Victor Vladimir William
""".split()
STREET_KINDS = "улица улицу улице ул. ул проспект проспекте просп. пр-т пр. переулок переулке пер. пер бульвар бульваре б-р набережная набережной наб. площадь площади пл. шоссе ш. проезд проезде пр-д тупик аллея мкр. мкр микрорайон мкрн. квартал".split()
LATIN_STREETS = "Street St. Lane Row Road Rd. Avenue Ave. Square Drive Court Way Place Terrace Hill Close Gardens Walk Mews Boulevard Crescent Park".split()
PHONE_WORDS = "тел телефон телефону звоните звонить позвоните контакты контакт связи номер записи вотсап whatsapp viber telegram phone call".split()
ID_WORDS = "паспорт паспорта паспортные снилс инн удостоверение удостоверения права ву passport полис".split()
OTHER_NUMBERS = "заказ заказа договор договора артикул лицензия лицензии партия счёт счет стаж размер огрн огрнип серии модель код промокод свидетельство накладная цена стоимость скидка".split()
MAIL_WORDS = "почта почту почте mail e-mail email пишите сюда адрес мейл".split()
PLACE_WORDS = "адрес адресу находится здесь салон офис мастерская".split()
NAME_WORDS = "зовут мастер уважением принимает задать передавать рекомендую салоне спросить спрашивать обращаться вопросы for master mr mrs dr специалист".split()
NOT_NAME_WORDS = "городу город г улица ул улицу проспект систему бренд материалах комплектов опыт аналоги обслуживаем установка работаем используем ооо ип".split()

_LABEL = r"(?:[a-zа-яё0-9][a-zа-яё0-9-]*|[A-ZА-ЯЁ0-9][A-ZА-ЯЁ0-9-]*)"
_MAIL = re.compile(
    rf"(?<![\w.+%-])[\w.+%-]*\w(?:@| @ |\s*[(\[]\s*(?:собака|at)\s*[)\]]\s*|\s+собака\s+){_LABEL}(?:(?:\.| \. |\s*[(\[]\s*(?:точка|dot)\s*[)\]]\s*|\s+точка\s+){_LABEL})+"
)
_AT = re.compile(r"@|собака|[(\[]\s*at\s*[)\]]")  # without one of these no mail address can match
_GLUE = r"(?:\s?[-‑–—/]\s?|\.(?!\s)|\s?\(|\)\s?[-‑–]?\s?|\s{1,2})?"
_CALL = re.compile(rf"(?<![\d№+])(?:\+?[78]{_GLUE}\d(?:{_GLUE}\d){{9}}|\(\d{{3,5}}\)(?:{_GLUE}\d){{5,7}}|\+\d{{1,3}}{_GLUE}\d(?:{_GLUE}\d){{6,11}})(?![\d])")
_DIGITS = re.compile(r"(?<![\d+(.,])\d(?:(?:[\s-]|\s?№\s?)?\d){7,14}(?![\d])")
_KIND = "|".join(re.escape(k) for k in sorted(STREET_KINDS, key=len, reverse=True))
_CAP = r"[А-ЯЁ][а-яё]+(?:-\d+|-[А-ЯЁа-яё]+)*"
_SIZE = "Большая|Большой|Малая|Малый|Старая|Старый|Новая|Новый|Верхняя|Верхний|Нижняя|Нижний|Первая|Вторая|Третья"
_HOUSE = (
    r",?\s*(?:(?:дом|д)\.?\s*)?№?\s?\d+(?:[А-ЯЁа-яё](?![а-яё]))?(?:\s?[/кk-]\s?\d+[А-ЯЁа-яё]?)?(?![\d])"
    r"(?:,?\s*(?:корпус|корп|строение|стр|литера|к|с)\.?\s*\d+[А-ЯЁа-яё]?)?"
    r"(?:,?\s*(?:квартира|кв|офис|оф|помещение|пом|комната)\.?\s*\d+)?"
)
_STREET = re.compile(
    rf"(?<!\w)(?:(?:{_KIND})\s*(?:[А-ЯЁ]\.\s?)*{_CAP}(?:\s{_CAP}){{0,2}}|(?:(?:{_SIZE})\s)?[А-ЯЁ][а-яё-]*(?:ая|яя|ий|ый|ой|ое|ее|ой|ова|ева|ина)\s(?:{_KIND})(?!\w))(?:{_HOUSE})"
)
_STREET_LATIN = re.compile(rf"(?<![\w-])\d+[A-Za-z]?\s(?:[A-Z][a-z]+\s){{1,3}}(?:{'|'.join(map(re.escape, LATIN_STREETS))})(?!\w)(?:,?\s?(?:apt|flat|unit|suite|ap)\.?\s?\d+)?")
_TOKEN = re.compile(r"[А-ЯЁ]\.(?=\s?[А-ЯЁ])|(?<=[А-ЯЁ]\.)[А-ЯЁ]\.|(?<=[А-ЯЁ]\. )[А-ЯЁ]\.|[A-Z]\.(?=\s[A-Z])|(?:[А-ЯЁ][а-яё]+|[А-ЯЁ]{3,}|[A-Z][a-z]+)(?:-[А-ЯЁ][а-яё]+)?|(?<=[а-яёА-ЯЁ] )[А-ЯЁ]\.")
_BEFORE = re.compile(r"([\w-]+)\W*$")
_PATRONYM = re.compile(r"(?i)(?:ович|евич|ьич|ич)(?:а|у|ем|ом|е)?$|(?:овн|евн|ичн|инишн)(?:а|ы|е|у|ой|ою)$")
_SURNAME = re.compile(r"(?i)(?:ов|ев|ёв|ин|ын)(?:а|у|ым|ом|е|ой|ою|ы)?$|(?:ск|цк)(?:ий|ого|ому|им|ом|ая|ой|ую)$|(?:енко|ук|юк|чук|ян|швили|дзе)(?:а|у|ом|е)?$")
_MASC = ("", "а", "у", "ом", "е", "я", "ю", "ем", "й", "ь")
_FEM = ("а", "ы", "е", "у", "ой", "ою", "я", "и", "ю", "ей", "ь")


def _fold(word: str) -> str:
    return word.lower().replace("ё", "е")


def _forms() -> frozenset[str]:
    """All cases of the gazetteer's names, by ending."""
    out = {n.lower() for n in LATIN_NAMES}
    for name in map(_fold, FIRST_NAMES):
        if name[-1] in "ая":
            stem = name[:-1]
            out |= {stem + e for e in _FEM if e}
        elif name[-1] in "йь":
            out |= {name[:-1] + e for e in _MASC} | {name}
        else:
            out |= {name + e for e in _MASC}
    out |= {"льва", "льву", "львом", "павла", "павлу", "павлом", "любови", "петра", "петру", "петром", "петре"}
    return frozenset(w for w in out if len(w) > 2)


FORMS = _forms()
_ID_SET, _PHONE_SET, _OTHER_SET, _MAIL_SET = map(frozenset, (ID_WORDS, PHONE_WORDS, OTHER_NUMBERS, MAIL_WORDS))
_PLACE_SET, _NAME_SET, _NOT_NAME_SET = map(frozenset, (PLACE_WORDS, NAME_WORDS, NOT_NAME_WORDS))
_LETTERS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


@dataclass
class Span:
    family: int
    start: int
    end: int
    votes: tuple[int, ...]
    marks: tuple[str, ...]


def _left_words(text: str, at: int, n: int = 3, reach: int = 48) -> list[str]:
    """Words before a place, nearest first, within its sentence."""
    piece = text[max(0, at - reach) : at]
    cut = max(piece.rfind("\n"), max((m.start() for m in re.finditer(r"(?<!тел)(?<!ул)(?<!\bг)(?<!\bд)[.!?;](?=\s)", piece.lower())), default=-1))
    return [w.lower() for w in _LETTERS.findall(piece[cut + 1 :])][::-1][:n]


def _mail_votes(text: str, a: int, b: int, left: list[str]) -> tuple[int, ...]:
    s = text[a:b]
    plain = re.fullmatch(r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)+", s) is not None
    hidden = re.search(r"собака|\bat\b|@", s, re.I) is not None and re.search(r"точка|dot|\.", s, re.I) is not None
    known = re.search(r"(?:\.|точка\s|\]\s?)\s?(?:ru|com|net|org|рф|[a-zа-яё]{4,})$", s, re.I) is not None
    return (EMAIL if plain else ABSTAIN, EMAIL if hidden else NONE, EMAIL if known else ABSTAIN, EMAIL if _MAIL_SET.intersection(left) else ABSTAIN)


def _number_votes(text: str, a: int, b: int, left: list[str]) -> tuple[int, ...]:
    s = text[a:b]
    digits = re.sub(r"\D", "", s)
    n, words = len(digits), set(left)
    lead = NONE
    if n == 11 and digits[0] in "78" or n == 10 and s[0] == "(" or s[0] == "+":
        lead = PHONE
    form = ABSTAIN
    if re.fullmatch(r"\d{2}\s?\d{2}\s*№?\s*\d{6}|\d{3}[\s-]\d{3}[\s-]\d{3}[\s-]\d{2}|\d{4}\s?\d{6}\s?\d{2}|\d{12}", s):
        form = IDENTITY
    elif re.search(r"^\+|[()/.]|\d\s?[-‑]\s?\d\d\s?[-‑]\s?\d\d$|^\d( \d)+$|^[78]\d{10}$|^[78] \d{3} ", s):
        form = PHONE
    near_id = IDENTITY if words & _ID_SET else ABSTAIN
    near_phone = PHONE if words & _PHONE_SET else ABSTAIN
    other = NONE if words & _OTHER_SET and not words & _ID_SET else ABSTAIN
    after = text[b : b + 28].lower()
    follow = PHONE if re.match(r"\W*(?:-\s*)?(?:пишите|в любое|\(мессенджеры|почта|whatsapp)", after) else NONE if re.match(r"\s*(?:гг|мм|руб|кв\.|%)", after) else ABSTAIN
    short = NONE if n < 10 else ABSTAIN
    return (lead, form, near_id, near_phone, other, follow, short)


def _street_votes(text: str, a: int, b: int, left: list[str]) -> tuple[int, ...]:
    s = text[a:b]
    kind = re.search(rf"(?<!\w)(?:{_KIND})(?!\w)", s) is not None or any(k in s for k in LATIN_STREETS)
    flat = re.search(r"кв|квартира|дом|д\.|корп|стр|apt", s) is not None
    near = bool(_PLACE_SET.intersection(left)) or re.search(r"(?:^|\W)(?:г\.|город)\s[^.\n]{2,30},\s*$", text[max(0, a - 40) : a]) is not None
    wrong = re.match(r"\s*(?:этаж|комнат|руб|кв\. м|мес|лет)", text[b : b + 12]) is not None
    return (ADDRESS if kind else NONE, ADDRESS if flat else ABSTAIN, ADDRESS if near else ABSTAIN, NONE if wrong else ABSTAIN, ADDRESS if re.search(r"\d", s) else NONE)


@lru_cache(maxsize=200_000)
def _part(token: str) -> str:
    """What a word can be in a name: first name, patronymic, surname, initial or nothing."""
    if token.endswith("."):
        return "i"
    w = _fold(token)
    if w in FORMS:
        return "f"
    if _PATRONYM.search(w) and len(w) > 4:
        return "p"
    if _SURNAME.search(w) and len(w) > 4:
        return "s"
    return "o"


def _person_votes(text: str, parts: str, before: str, after: str, left: list[str], latin: bool, inside: bool) -> tuple[int, ...]:
    known = NAME if "f" in parts or "p" in parts or "i" in parts else NONE
    usual = NAME if latin and parts[0] == "f" and len(parts) == 2 or re.fullmatch(r"fs|sf|sfp|fps|fp|i{1,2}s|si{1,2}|fpss?", parts) else NONE
    # a span is whole if no neighbour could belong to it
    whole = NONE if before in ("f", "p", "s", "i") or after in ("f", "p", "s", "i") else NAME if "o" not in parts or latin else ABSTAIN
    near = NAME if left and left[0] in _NAME_SET else NONE if left and left[0] in _NOT_NAME_SET else ABSTAIN
    return (known, usual, whole, near, NONE if inside else ABSTAIN)


LABELERS = {0: 4, 1: 7, 2: 5, 3: 5}
ALLOWED = {0: (NONE, EMAIL), 1: (NONE, PHONE, IDENTITY), 2: (NONE, ADDRESS), 3: (NONE, NAME)}


def propose(text: str) -> list[Span]:
    """Candidate spans with votes and marks (features of form and context)."""
    out: list[Span] = []
    taken, in_street = bytearray(len(text)), bytearray(len(text))

    def add(family: int, a: int, b: int, votes: tuple[int, ...], left: list[str], *marks: str) -> None:
        tail = text[b : b + 2]
        out.append(Span(family, a, b, votes, (*(f"l{i}={w}" for i, w in enumerate(left[:2])), f"n={min(sum(c.isdigit() for c in text[a:b]), 16)}", f"r={tail[:1]}", *marks)))

    for m in _MAIL.finditer(text) if _AT.search(text) else ():
        left = _left_words(text, m.start())
        add(0, m.start(), m.end(), _mail_votes(text, m.start(), m.end(), left), left)
        taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    streets = [m.span() for rx in (_STREET, _STREET_LATIN) for m in rx.finditer(text)]
    for a, b in streets:
        left = _left_words(text, a)
        add(2, a, b, _street_votes(text, a, b, left), left)
        in_street[a:b] = b"\1" * (b - a)
    for rx in (_CALL, _DIGITS):
        for m in rx.finditer(text):
            a, b = m.span()
            if taken.find(1, a, b) >= 0:
                continue
            taken[a:b] = b"\1" * (b - a)
            left = _left_words(text, a)
            add(1, a, b, _number_votes(text, a, b, left), left, "f=" + re.sub(r"\d", "9", text[a:b])[:18])
    run: list[tuple[int, int, str, str]] = []
    tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)] + [(1 << 60, 1 << 60, "")]
    for a, b, word in tokens:
        if run:
            gap = text[run[-1][1] : a] if a < 1 << 59 else "#"
            if gap not in (" ", " ", "  ") and not (gap == "" and run[-1][2].endswith(".")) or (a and a < 1 << 59 and text[a - 1].isalnum()):
                _names(text, run, in_street, add)
                run = []
        if a < 1 << 59 and not (a and (text[a - 1].isalnum() or text[a - 1] in "@_")) and not (b < len(text) and (text[b].isalpha() and text[b - 1] != "." or text[b] in "@_")):
            run.append((a, b, word, _part(word)))
    return out


def _names(text: str, run: list[tuple[int, int, str, str]], in_street: bytearray, add) -> None:
    if len(run) < 2:
        return
    for i in range(len(run)):
        for j in range(i + 2, min(i + 4, len(run)) + 1):
            part = run[i:j]
            parts = "".join(x[3] for x in part)
            if not set(parts) - {"o"} or parts == "ss" or parts.strip("i") == "":
                continue
            a, b = part[0][0], part[-1][1]
            latin = part[-1][2].isascii() and part[0][2].isascii()
            left = [run[i - 1][2].lower()] if i else _left_words(text, a)
            before, after = run[i - 1][3] if i else "", run[j][3] if j < len(run) else ""
            inside = in_street.find(1, a, b) >= 0
            add(3, a, b, _person_votes(text, parts, before, after, left, latin, inside), left, "p=" + parts, f"b={before}", f"a={after}", f"latin={latin}", f"in={inside}")
    # longer names: stretches of nothing but name parts, each as a whole
    i = 0
    while i < len(run):
        j = i
        while j < len(run) and run[j][3] != "o":
            j += 1
        if j - i > 4 and any(x[3] != "i" for x in run[i:j]):
            a, b = run[i][0], run[j - 1][1]
            left, latin, inside = [run[i - 1][2].lower()] if i else _left_words(text, a), run[i][2].isascii() and run[j - 1][2].isascii(), in_street.find(1, a, b) >= 0
            add(3, a, b, _person_votes(text, "".join(x[3] for x in run[i:j]), "", "", left, latin, inside), left, "p=long", f"latin={latin}", f"in={inside}")
        i = max(j, i + 1)


@dataclass
class LabelModel:
    """Dawid-Skene: prior by class, confusion[labeler][class][vote + 1]."""

    classes: tuple[int, ...]
    prior: np.ndarray
    confusion: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log = np.log(self.prior)[None, :] + sum(np.log(self.confusion[j][:, votes[:, j] + 1]).T for j in range(votes.shape[1]))
        log -= log.max(1, keepdims=True)
        p = np.exp(log)
        return p / p.sum(1, keepdims=True)


def fit_labels(counts: dict[tuple[int, ...], int], classes: tuple[int, ...], labelers: int, rounds: int = 60) -> LabelModel:
    """Expectation-maximisation over vote patterns with their counts, begun from the majority vote."""
    k, width = len(classes), len(KINDS) + 1
    prior, confusion = np.full(k, 1 / k), np.full((labelers, k, width), 1 / width)
    if not counts:
        return LabelModel(classes, prior, confusion)
    votes = np.array(list(counts), np.int64).reshape(len(counts), labelers)
    weight = np.array(list(counts.values()), float)
    post = np.array([[(row == c).sum() + 0.05 for c in classes] for row in votes], float)
    post /= post.sum(1, keepdims=True)
    for _ in range(rounds):
        mass = post * weight[:, None]
        prior = (mass.sum(0) + 1.0) / (mass.sum() + k)
        for j in range(labelers):
            table = np.full((k, width), 0.1)
            np.add.at(table.T, votes[:, j] + 1, mass)
            confusion[j] = table / table.sum(1, keepdims=True)
        post = LabelModel(classes, prior, confusion).posterior(votes)
    return LabelModel(classes, prior, confusion)


#: Hashed features of the classifier, and most training spans of a family; documented bounds.
BUCKETS, TRAIN_SPANS = 1 << 11, 30_000


def features(span: Span) -> list[int]:
    names = [f"v{j}={v}" for j, v in enumerate(span.votes)] + list(span.marks)
    return [zlib.crc32(f"{span.family}|{n}".encode()) % BUCKETS for n in names] + [BUCKETS]


def train_classifier(rows: list[list[int]], targets: np.ndarray, weight: np.ndarray, rounds: int = 300, rate: float = 0.5, ridge: float = 1e-5) -> np.ndarray:
    """Softmax regression on sparse binary features with soft targets, by AdaGrad on the whole sample; ``weight`` counts equal rows."""
    k, weight = targets.shape[1], weight[:, None] / weight.sum()
    w, seen = np.zeros((BUCKETS + 1, k)), np.full((BUCKETS + 1, k), 1e-8)
    width = max(map(len, rows))
    index = np.full((len(rows), width), BUCKETS + 1, np.int64)
    for i, r in enumerate(rows):
        index[i, : len(r)] = r
    for _ in range(rounds):
        z = np.vstack([w, np.zeros((1, k))])[index].sum(1)
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        g = (p - targets) * weight
        grad = np.zeros((BUCKETS + 2, k))
        for c in range(k):
            grad[:, c] = np.bincount(index.ravel(), np.repeat(g[:, c], width), BUCKETS + 2)
        step = grad[:-1] + ridge * w
        seen += step**2
        w -= rate * step / np.sqrt(seen)
    return w


@dataclass
class PrivateModel:
    labels: list[LabelModel]
    weights: list[np.ndarray | None]

    def decide(self, span: Span) -> tuple[int, float]:
        """(class, probability)."""
        w, classes = self.weights[span.family], ALLOWED[span.family]
        if w is None:
            return NONE, 1.0
        z = w[features(span)].sum(0)
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return classes[best], float(p[best])

    def resolve(self, spans: list[Span], size: int) -> list[tuple[int, int, str]]:
        """(start, end, kind) of what is personal, without overlaps: mail and street addresses first, then numbers, then the longest names."""
        memo: dict[tuple, tuple[int, float]] = {}
        kept, covered, ranked = [], bytearray(size), []
        for s in spans:
            key = (s.family, s.votes, s.marks)
            if key not in memo:
                memo[key] = self.decide(s)
            c, _ = memo[key]
            if c != NONE:
                ranked.append(({0: 0, 2: 1, 1: 2, 3: 3}[s.family], -(s.end - s.start), s.start, s.end, c))
        for _, _, a, b, c in sorted(ranked):
            if covered.find(1, a, b) < 0:
                covered[a:b] = b"\1" * (b - a)
                kept.append((a, b, KINDS[c]))
        return sorted(kept)

    def find(self, text: str | None) -> list[tuple[int, int, str]]:
        return self.resolve(propose(text), len(text)) if text else []

    def redact(self, text: str | None) -> str | None:
        if text is None:
            return None
        for a, b, kind in reversed(self.find(text)):
            text = text[:a] + PLACEHOLDERS[kind] + text[b:]
        return text


_SPAN = "struct<family:int,a:int,b:int,votes:array<int>,marks:array<string>,found:string>"
_SPAN_ARROW = pa.struct([("family", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("votes", pa.list_(pa.int32())), ("marks", pa.list_(pa.string())), ("found", pa.string())])


def proposals(df: DataFrame, key: str | None, text: str) -> DataFrame:
    """(key, spans) of the rows whose text has candidate spans, proposed once and written to the shared folder. Without ``key``, spans only."""
    kept = df.select(*([F.col(f"`{key}`").alias(key)] if key else [F.lit(1).alias("key")]), F.col(f"`{text}`").alias("__text")).where(F.length("__text") > 0)
    name, kind = kept.columns[0], kept.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, spans = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if found := propose(t):
                    rows.append(i)
                    spans.append([{"family": s.family, "a": s.start, "b": s.end, "votes": s.votes, "marks": s.marks, "found": t[s.start : s.end]} for s in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(spans, pa.list_(_SPAN_ARROW))], names=[name, "spans"])

    return stage(kept.mapInArrow(run, f"`{name}` {kind}, spans array<{_SPAN}>"), "spans")


def _spans(cell: list[dict]) -> list[Span]:
    return [Span(s["family"], s["a"], s["b"], tuple(s["votes"]), tuple(s["marks"])) for s in cell]


def learn(df: DataFrame, text: str) -> PrivateModel:
    return learn_from(proposals(df, None, text))


def learn_from(proposed: DataFrame) -> PrivateModel:
    """Label models from the vote patterns of all proposed spans, classifiers from a bounded sample of them.

    Patterns are counted where the spans are; there are as many as combinations of votes, however many texts. Training takes the TRAIN_SPANS
    spans of a family with the smallest hashes.
    """
    spans = proposed.select(F.explode("spans").alias("s")).select("s.*")
    patterns: dict[int, dict] = {f: {} for f in LABELERS}
    for r in spans.groupBy("family", "votes").agg(F.count(F.lit(1)).alias("n")).collect():
        patterns[r["family"]][tuple(r["votes"])] = r["n"]
    labels, weights = [], []
    for f, n in LABELERS.items():
        model = fit_labels(patterns[f], ALLOWED[f], n)
        labels.append(model)
        rows = spans.where(F.col("family") == f).orderBy(F.xxhash64("a", "b", "found", "marks"), "votes", "marks").limit(TRAIN_SPANS).select("votes", "marks").collect()
        if not rows:
            weights.append(None)
            continue
        same = Counter((tuple(r["votes"]), tuple(r["marks"])) for r in rows)
        post = model.posterior(np.array([v for v, _ in same], np.int64))
        weights.append(train_classifier([features(Span(f, 0, 0, v, m)) for v, m in same], post, np.array(list(same.values()), float)))
    return PrivateModel(labels, weights)


def find_private(df: DataFrame, key: str, text: str, model: PrivateModel | None = None) -> DataFrame:
    """(key, kind, found_text, span_start, span_end) of every finding; offsets in code points.

    Null and empty texts give no rows; repeated rows each give theirs; texts are read whole and once; only two columns are read; no shuffle but those of the
    vote counts and of the bounded training sample.
    """
    outs = ("kind", "found_text", "span_start", "span_end")
    if key in outs or key == "spans":
        raise ValueError("the key may not have an output's name")
    proposed = proposals(df, key, text)
    shared = df.sparkSession.sparkContext.broadcast(model or learn_from(proposed))
    kind = proposed.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            rows, cols = [], ([], [], [], [])
            for i, cell in enumerate(batch.column(1).to_pylist()):
                text_of = {(s["a"], s["b"]): s["found"] for s in cell}
                for a, b, k in m.resolve(_spans(cell), max(s["b"] for s in cell)):
                    rows.append(i)
                    for c, v in zip(cols, (k, text_of[a, b], a, b)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=[key, *outs]
            )

    return proposed.mapInArrow(run, f"`{key}` {kind}, kind string, found_text string, span_start int, span_end int")


def redact(df: DataFrame, text: str, model: PrivateModel | None = None, *, out: str = "redacted") -> DataFrame:
    """``df`` with a column of the text with placeholders; null stays null, all columns and rows are kept.

    Spans are proposed once: rows are written with them, the model is learned from there (as by ``find_private`` on the same rows), and decides there.
    """
    kept = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{text}`").alias("t"))
    schema = T.StructType([kept.schema["row"], T.StructField("spans", T.DataType.fromDDL(f"array<{_SPAN}>"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [{"family": s.family, "a": s.start, "b": s.end, "votes": s.votes, "marks": s.marks, "found": t[s.start : s.end]} for s in propose(t)] or None if t else None for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(_SPAN_ARROW))], names=["row", "spans"])

    rows = stage(kept.mapInArrow(run, schema), "spans")
    shared = df.sparkSession.sparkContext.broadcast(model or learn_from(rows.where(F.col("spans").isNotNull())))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = []
            for t, cell in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for a, b, kind in reversed(m.resolve(_spans(cell), len(t))) if cell else ():
                    t = t[:a] + PLACEHOLDERS[kind] + t[b:]
                texts.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "t"])

    done = rows.select("row", F.col(f"row.`{text}`").alias("t"), "spans").mapInArrow(clean, T.StructType([kept.schema["row"], T.StructField("t", T.StringType())]))
    return done.select("row.*", F.col("t").alias(out))
