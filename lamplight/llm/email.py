"""The newly written text of e-mails.

A semi-Markov model labels spans of lines as authored, quoted, signature or notice. A span's
score has the cues of its lines, cues at its boundaries (what it starts with, blank lines
before, after and within), its length, and features of the whole span (unprefixed lines of a
quotation, whether a forwarded message reaches the end, how legal its words are, where it
stands). The weights are learned by a structured perceptron from messages composed of labelled
sample sentences and of phrases that are written for training alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ("authored", "quoted", "signature", "notice")
#: Messages composed for training, and passes over them.
TRAINING_MESSAGES, PASSES = 900, 4
#: Lines a single span has at most; a longer one is several spans of one label.
SPAN_LINES = 160
#: Starts of spans that are scored at once; memory is STARTS x SPAN_LINES scores whatever the mail.
STARTS = 256
#: Parts of the training notices: a message with notices of one part is read with word weights from the others.
FOLDS = 5
#: Characters of a word that its stem keeps.
STEM = 6

# Words and forms of mails that programs and people use in the languages of the corpus.
CLOSINGS = [
    "Best regards", "Kind regards", "Regards", "Sincerely yours", "Yours sincerely", "Thanks", "Many thanks", "Cheers", "Best wishes",
    "Mit freundlichen Grüßen", "Freundliche Grüße", "Viele Grüße", "Beste Grüße", "Herzliche Grüße", "Cordialement", "Bien à vous", "Bien cordialement", "Salutations",
    "Saludos cordiales", "Un saludo", "Saludos", "Atentamente", "С уважением", "Всего доброго", "Trân trọng", "Thân mến", "Kính thư",
]
DEVICE = (
    r"^\s*(?:sent\s+(?:from|via|with|using)\s|get\s+\S+\s+for\s+(?:ios|android)|von\s.{2,40}\sgesendet|gesendet\s+(?:von|mit|aus|über)\s|envoyé\s+(?:de|depuis|avec|via)\s|à\s+partir\s+de\s+mon\s"
    r"|enviado\s+(?:de|desde|con|vía)\s|отправлено\s+(?:с|со|из|через)\s|(?:được\s+|đã\s+)?gửi\s+(?:từ|bằng|qua)\s)"
)
WROTE = ["wrote", "schrieb", "a écrit", "escribió", "đã viết", "написал", "написала", "пишет"]
MARKERS = ["Original Message", "Forwarded message", "Ursprüngliche Nachricht", "Weitergeleitete Nachricht", "Message d'origine", "Message transféré", "Mensaje original", "Mensaje reenviado", "Исходное сообщение", "Пересылаемое сообщение", "Thư gốc", "Thư được chuyển tiếp"]
HEADER_LABELS = ["From", "Sent", "To", "Cc", "Date", "Subject", "Von", "Gesendet", "An", "Betreff", "Datum", "De", "Envoyé", "À", "A", "Objet", "Enviado", "Para", "Asunto", "Fecha", "От", "Отправлено", "Кому", "Тема", "Дата", "Từ", "Đã gửi", "Gửi", "Đến", "Tới", "Chủ đề", "Ngày"]
POSTSCRIPTS = ["PS", "P.S.", "P. S.", "Tái bút", "П.С.", "З.Ы.", "NB", "Nachtrag"]

# Legal notices written for training; words, not sentences, are what the model takes from them.
NOTICES = [
    "The information in this e-mail is confidential and legally privileged. Access by anyone other than the intended recipient is unauthorised.",
    "If you are not the intended recipient, any disclosure, copying or distribution is prohibited and may be unlawful.",
    "Should this mail have reached you by mistake, notify us at once, erase every copy and do not use or forward its contents.",
    "DISCLAIMER: opinions in this e-mail are solely those of the writer and are not binding on the firm or its affiliates.",
    "Although we scan outgoing mail for viruses, no liability is accepted for damage caused by this e-mail or by attachments.",
    "Save paper: consider the environment before printing this e-mail.",
    "Registered in England. Nothing in this communication constitutes an offer, legal advice or a binding contract unless confirmed in writing.",
    "This communication is private and confidential; it is meant exclusively for the addressee and must be deleted if received in error.",
    "Diese E-Mail enthält vertrauliche oder rechtlich geschützte Informationen. Wenn Sie nicht der richtige Adressat sind, informieren Sie bitte sofort den Absender und vernichten Sie diese E-Mail.",
    "Das unerlaubte Kopieren sowie die unbefugte Weitergabe dieser E-Mail sind nicht gestattet.",
    "Haftungsausschluss: Aussagen in E-Mails sind für unser Haus rechtlich unverbindlich, solange sie nicht schriftlich bestätigt sind.",
    "Sollten Sie diese Mitteilung versehentlich bekommen haben, bitten wir um Nachricht und Löschung; jede Verwendung des Inhalts ist untersagt.",
    "Sitz der Gesellschaft und Registergericht stehen im Impressum. Denken Sie an die Umwelt, bevor Sie diese Mail ausdrucken.",
    "Vertraulichkeitshinweis: bestimmt ausschließlich für den Empfänger; der Inhalt ist verbindlich erst nach schriftlicher Bestätigung.",
    "Les informations contenues dans ce courriel sont confidentielles et destinées exclusivement à la personne à laquelle il est adressé.",
    "Si vous n'êtes pas le destinataire, toute copie ou diffusion est interdite ; veuillez avertir l'expéditeur et supprimer ce message.",
    "Clause de non-responsabilité : les opinions exprimées n'engagent que leur auteur et non l'entreprise ou la société qui l'emploie.",
    "En cas de réception par erreur, détruisez ce courriel et ses pièces jointes ; son contenu ne peut être ni utilisé ni divulgué.",
    "Avis de confidentialité : message réservé à l'usage du destinataire. N'imprimez ce courriel que si nécessaire.",
    "La información contenida en este correo es confidencial y está destinada únicamente a la persona a la que se dirige.",
    "Si usted no es el destinatario, queda prohibida cualquier copia o divulgación; avise al remitente y borre el mensaje.",
    "Nota jurídica: las opiniones de este correo son del autor y no comprometen legalmente a la compañía ni a la empresa del grupo.",
    "En caso de recepción por error, rogamos eliminar este mensaje y sus anexos; su contenido está protegido por secreto profesional.",
    "Cláusula de confidencialidad: uso exclusivo del destinatario. Antes de imprimir este correo piense en el medio ambiente.",
    "Информация в данном письме и вложениях является конфиденциальной и предназначена исключительно для адресата.",
    "Если вы не являетесь получателем, любое копирование, передача или раскрытие содержания запрещены; сообщите отправителю и удалите письмо.",
    "Отказ от ответственности: мнение автора письма не является позицией компании и не влечёт обязательств.",
    "В случае ошибочного получения просим уничтожить это сообщение и все копии; использование содержания не допускается.",
    "Уведомление о конфиденциальности: доступ имеет только указанное лицо. Подумайте о природе, прежде чем печатать письмо.",
    "Thông tin trong thư điện tử này là thông tin mật và chỉ gửi cho đúng người nhận.",
    "Nếu quý vị không phải là người nhận, mọi việc sao chép hoặc phát tán đều bị cấm; vui lòng báo lại người gửi và xóa thư.",
    "Miễn trừ trách nhiệm: ý kiến trong thư là của người viết và không ràng buộc công ty.",
    "Trường hợp nhận được do nhầm lẫn, xin hủy thư và tệp đính kèm; không được tiết lộ hay sử dụng nội dung.",
    "Thông báo bảo mật: nội dung chỉ dành riêng cho người được ghi tên. Hãy nghĩ đến môi trường trước khi in thư.",
]
DEVICES = [
    "Sent from Mail for Windows", "Sent via webmail", "Sent from my tablet, sorry for typos", "Get Courier for Android", "Gesendet mit der Post-App", "Gesendet von meinem Tablet", "Von meinem Rechner gesendet",
    "Envoyé depuis l'application Courrier", "Envoyé avec ma tablette", "Enviado con la aplicación de correo", "Enviado desde mi tableta", "Отправлено с планшета", "Отправлено из приложения почты", "Gửi bằng ứng dụng thư", "Gửi từ máy tính bảng",
]
GREETINGS = ["Hey there,", "Morning all,", "Dear colleagues,", "Sehr geehrte Damen und Herren,", "Moin,", "Cher collègue,", "Salut,", "Estimado colega,", "Hola:", "Здравствуйте,", "Коллеги,", "Anh thân,", "Chị ơi,"]
ROLES = ["Head of Archives", "Leiterin Einkauf", "Chargée de mission", "Jefe de turno", "Инженер смены", "Trưởng nhóm vận hành", "Kalobrex Ltd"]

_ALT = lambda words: "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
_HEADER = re.compile(r"^(?:Subject|From|To|Cc|Bcc|Date|Reply-To):", re.I)
_ATTACHMENT = re.compile(r"^\s*\[attachment: .*\]\s*$")
_PREFIX = re.compile(r"^\s{0,3}[>|]")
_INTRO = re.compile(rf"(?:(?:{_ALT(WROTE)})(?:\([^)]*\))?(?:\s+(?:am|on|le|el|vào))?[\s\d./:,-]*|\b(?:{_ALT(WROTE)})\b.{{0,60}}[\d>])\s*:$", re.I)
_MARKER = re.compile(rf"^\s*(?:[-_=*]{{3,}}\s*(?:{_ALT(MARKERS)}|[^\W\d_][^\n]{{3,40}}?)\s*[-_=*]{{3,}}|_{{12,}}|-{{12,}}|begin forwarded message:)\s*$", re.I)
_LABEL = re.compile(rf"^\s*\*?(?:{_ALT(HEADER_LABELS)})\s?:\*?\s")
_CLOSING = re.compile(rf"^\s*(?:{_ALT(CLOSINGS)})\s*[,.!]?\s*$", re.I)
_SEPARATOR = re.compile(r"^\s*(?:--|—|–|\*{3,}|_{2,11}|-{2,11}|={2,})\s*$")
_DEVICE = re.compile(DEVICE, re.I)
_STEMS = re.compile(r"[^\W\d_]{2,}")
_CONTACT = re.compile(r"^\s*(?:Tel|Phone|Fon|Fax|Mobile|Mob)\b|\S+@\S+|\s\|\s|www\.|https?://", re.I)
_PS = re.compile(rf"^\s*(?:{_ALT(POSTSCRIPTS)})\s*[:.]?\s", re.I)
_SENTENCE = re.compile(r"[.!?…][\"”»)]*\s*$")

#: Line cues, in the order of the columns of cues().
CUES = ("prefix", "intro", "marker", "label", "closing", "separator", "device", "notice", "contact", "ps", "short", "sentence", "long", "bullet", "comma", "labels")
_K = len(CUES)
_EXTRA = 18
_LENGTHS = np.array([0, 0, 1, 2, 3, 4, 4, 5, 5, 5, 5, 6])


def legal_weights(notices: list[str], others: list[str]) -> dict[str, float]:
    """How much more often a stem is in notices than in other text (log-odds, both sets of one weight)."""
    stems = lambda ts: Counter(w for t in ts for w in {m[:STEM].lower() for m in _STEMS.findall(t)})
    p, n = stems(notices), stems(others)
    scale = len(notices) / max(len(others), 1)
    return {w: float(np.log((p[w] + 0.3) / (n[w] * scale + 0.3))) for w in p | n}


def legality(line: str, legal: dict[str, float]) -> float:
    """Mean weight of a line's stems, about 1 for wholly legal words; unknown stems count 0."""
    stems = [m[:STEM].lower() for m in _STEMS.findall(line)]
    return float(np.clip(sum(legal.get(w, 0.0) for w in stems) / (len(stems) + 2), -1, 2)) if stems else 0.0


def cues(lines: list[str], legal: dict[str, float]) -> np.ndarray:
    x = np.zeros((len(lines), _K))
    for k, line in enumerate(lines):
        s = line.strip()
        row = x[k]
        row[0] = bool(_PREFIX.match(line))
        if row[0]:
            continue
        row[2], row[3] = bool(_MARKER.match(line)), bool(_LABEL.match(line + " "))
        row[4], row[5], row[6] = bool(_CLOSING.match(line)), bool(_SEPARATOR.match(line)), bool(_DEVICE.match(line)) and len(s) < 70
        row[7], row[8], row[9] = legality(s, legal), bool(_CONTACT.search(s)), bool(_PS.match(line + " "))
        row[11] = bool(_SENTENCE.search(s))
        row[10] = len(s) <= 40 and not row[11] and not s.endswith((",", ":", ";"))
        row[12], row[13], row[14] = len(s) > 50, s[:2] in ("- ", "* ", "• "), len(s) <= 40 and s.endswith((",", ":", "!"))
    for k, line in enumerate(lines):
        if x[k, 0]:
            continue
        one = line.strip()
        two = f"{one} {lines[k + 1].strip()}" if k + 1 < len(lines) and not x[k + 1, 0] and len(one) < 90 else one
        if _INTRO.search(one) or (not _SENTENCE.search(one) and _INTRO.search(two)):
            x[k, 1] = 1
        # header lines of an earlier message come in groups
        x[k, 15] = x[k, 3] and ((k + 1 < len(lines) and x[k + 1, 3]) or (k > 0 and x[k - 1, 3]))
    return x


@dataclass
class Message:
    """The lines that are to be labelled: numbers (from 1), cues, blank lines before each."""

    numbers: np.ndarray
    x: np.ndarray
    gap: np.ndarray
    header: list[int]


def parse(text: str, legal: dict[str, float]) -> Message:
    """Own header lines at the top and attachment lines are set apart."""
    lines = text.split("\n")
    top = 0
    while top < len(lines) and (_HEADER.match(lines[top]) or (top and lines[top][:1] in " \t" and lines[top].strip())):
        top += 1
    numbers, gap, blank = [], [], True
    for k in range(top, len(lines)):
        if not lines[k].strip():
            blank = True
        elif not _ATTACHMENT.match(lines[k]):
            numbers.append(k + 1)
            gap.append(blank)
            blank = False
    return Message(np.array(numbers, np.int64), cues([lines[k - 1].rstrip("\r") for k in numbers], legal), np.array(gap, float), list(range(1, top + 1)))


@dataclass
class Sums:
    """Running sums of a message, from which the features of any span follow."""

    x: np.ndarray
    cum: np.ndarray
    gap: np.ndarray
    gaps: np.ndarray

    @staticmethod
    def of(m: Message) -> Sums:
        cum = np.concatenate([np.zeros((1, _K)), np.cumsum(m.x, axis=0)])
        return Sums(m.x, cum, np.concatenate([m.gap, [1.0]]), np.concatenate([[0.0], np.cumsum(m.gap)]))

    def extras(self, start: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
        """Boundary and whole-span features of spans (start, stop), each of the shape of stop."""
        x, n = self.x, len(self.x)
        lines = stop - start
        prefixed = self.cum[stop, 0] - self.cum[start, 0]
        plain = lines - prefixed
        opens, intro = np.maximum(x[start, 2], x[start, 15]), x[start, 1]
        last = (stop == n).astype(float)
        before, after = self.gap[start], self.gap[stop]
        legal = (self.cum[stop, 7] - self.cum[start, 7]) / lines  # of the whole span, a line on average
        sentences = (self.cum[stop, 11] - self.cum[start, 11]) / lines
        apart = before * after
        same = np.ones_like(lines, float)
        return [
            before * same, after, self.gaps[stop] - self.gaps[start] - before,
            plain * opens, np.maximum(plain - 2, 0) * intro, plain * (1 - opens) * (1 - intro),
            last * opens, (1 - last) * opens, (prefixed > 0) * intro, (start == 0) * same, last, same,
            np.maximum(legal, 0), np.maximum(legal - 0.4, 0), (legal > 0.25) * apart, (legal > 0.25) * last, apart * (lines == 1) * (sentences == 0), sentences * apart,
        ]

    def features(self, start: int, stop: int) -> np.ndarray:
        rest = [float(np.ravel(e)[0]) for e in self.extras(np.array([start]), np.array([stop]))]
        return np.concatenate([self.cum[stop] - self.cum[start], self.x[start], rest])


@dataclass
class Model:
    """Weights: span features by label, length classes by label, transitions; and of legal words."""

    span: np.ndarray
    length: np.ndarray
    move: np.ndarray
    legal: dict[str, float]

    @staticmethod
    def empty(legal: dict[str, float] | None = None) -> Model:
        return Model(np.zeros((2 * _K + _EXTRA, 4)), np.zeros((7, 4)), np.zeros((5, 4)), legal or {})

    def parse(self, text: str) -> Message:
        return parse(text, self.legal)

    def decode(self, m: Message) -> list[tuple[int, int, int]]:
        """Best spans (start, stop, label) by dynamic programming over spans.

        The scores of all spans from STARTS starts are made at once, and only the last two such
        blocks are kept, so memory grows with the lines alone.
        """
        n = len(m.x)
        if n == 0:
            return []
        width = min(n, SPAN_LINES)
        sums = Sums.of(m)
        total, first = sums.cum @ self.span[:_K], m.x @ self.span[_K : 2 * _K]
        per_length = self.length[_LENGTHS[np.minimum(np.arange(1, width + 1), len(_LENGTHS) - 1)]]

        def block(a: int) -> np.ndarray:
            start = np.arange(a, min(a + STARTS, n))[:, None]
            stop = np.minimum(start + 1 + np.arange(width)[None, :], n)
            score = total[stop] - total[start] + first[start] + per_length[None]
            for e, w in zip(sums.extras(start, stop), self.span[2 * _K :], strict=True):
                score += e[:, :, None] * w
            return score

        kept: dict[int, np.ndarray] = {}
        best = np.full((n + 1, 4), -np.inf)
        back = np.zeros((n + 1, 4, 2), np.int64)
        enter = np.zeros((n, 4))
        came = np.zeros((n, 4), np.int64)
        for j in range(n + 1):
            if j:
                a = max(0, j - width)
                if (j - 1) // STARTS not in kept:
                    kept[(j - 1) // STARTS] = block((j - 1) // STARTS * STARTS)
                    kept = {b: v for b, v in kept.items() if (b + 1) * STARTS > a}
                parts = []
                for b in sorted(kept):
                    at = np.arange(max(a, b * STARTS), min(j, (b + 1) * STARTS))
                    parts.append(kept[b][at - b * STARTS, j - at - 1])
                got = enter[a:j] + (parts[0] if len(parts) == 1 else np.concatenate(parts))
                k = got.argmax(axis=0)
                best[j] = got[k, np.arange(4)]
                back[j, :, 0], back[j, :, 1] = a + k, came[a + k, np.arange(4)]
            if j < n:
                if j == 0:
                    enter[0], came[0] = self.move[4], 4
                else:
                    step = best[j][:, None] + self.move[:4]
                    came[j] = step.argmax(axis=0)
                    enter[j] = step[came[j], np.arange(4)]
        out, j, y = [], n, int(best[n].argmax())
        while j:
            i, before = back[j, y]
            out.append((int(i), j, y))
            j, y = int(i), int(before)
        return out[::-1]

    def labels(self, m: Message) -> np.ndarray:
        y = np.zeros(len(m.x), np.int64)
        for i, j, k in self.decode(m):
            y[i:j] = k
        return y

    def learn(self, sums: Sums, spans: list[tuple[int, int, int]], rate: float) -> None:
        before = 4
        for i, j, y in spans:
            self.span[:, y] += rate * sums.features(i, j)
            self.length[_LENGTHS[min(j - i, len(_LENGTHS) - 1)], y] += rate
            self.move[before, y] += rate
            before = y


@dataclass(frozen=True)
class Phrases:
    """What messages are composed of beside sample sentences."""

    notices: tuple[str, ...] = tuple(NOTICES)
    closings: tuple[str, ...] = tuple(CLOSINGS)
    devices: tuple[str, ...] = tuple(DEVICES)
    greetings: tuple[str, ...] = tuple(GREETINGS)
    roles: tuple[str, ...] = tuple(ROLES)


def compose(samples: list[tuple[str, str]], rng: np.random.Generator, phrases: Phrases, unlisted: float = 0.3) -> tuple[str, list[int]]:
    """A message of sample sentences and the label of each line (-1 for blank lines).

    unlisted: share of closings and device lines that are words of a sample, so that the model
    must know them by their place and form.
    """
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    lang = pick(sorted({x for x, _ in samples}))
    texts = [t for x, t in samples if x == lang]
    name = lambda: " ".join("".join(pick(["ka", "lo", "mi", "ster", "ne", "bru", "da"]) for _ in range(int(rng.integers(2, 4)))).title() for _ in range(2))
    date = lambda: pick(["2024-03-17", "17.03.2024", "17/3/2024"])
    lines: list[tuple[str, int]] = []

    def wrap(t: str, width: int) -> list[str]:
        out, row = [], ""
        for w in t.split():
            if row and len(row) + len(w) >= width:
                out.append(row)
                row = w
            else:
                row = f"{row} {w}".strip()
        return [*out, row]

    def para(label: int, wide: bool | None = None, text: str | None = None) -> None:
        t = text or pick(texts)
        wide = rng.random() < 0.5 if wide is None else wide
        lines.extend((x, label) for x in ([t] if wide else wrap(t, int(rng.integers(55, 80)))))

    def blank() -> None:
        lines.append(("", -1))

    def quote(intro: bool) -> None:
        mark = pick(["> ", ">", ">  ", "| "])
        who, mail = name(), "x.y@mail.example"
        verb = pick(WROTE)
        if intro:
            form = pick([f"On {date()}, {who} {verb}:", f"On {date()} at 09:11, {who} <{mail}>\n{verb}:", f"{who} <{mail}> {verb} on {date()}:", f"{date()} {who} {verb}:", f"At {date()} you wrote:", f"{who} {verb} am\n{date()}:", f"{date()}, {who} <{mail}> {verb}:"])
            lines.extend((x, 1) for x in form.split("\n"))
            if rng.random() < 0.1:
                blank()
        for t in (pick(texts) for _ in range(int(rng.integers(1, 3)))):
            deep = mark if rng.random() < 0.2 else ""
            for x in wrap(t, 66):
                lines.append((f"{mark}{deep}{x}", 1))
                if rng.random() < 0.03:
                    lines.append((mark.strip(), 1))

    if rng.random() < 0.6:
        lines.append((pick(phrases.greetings), 0))
        blank()
    if rng.random() < 0.15:
        quote(True)
        blank()
    for _ in range(int(rng.integers(1, 3))):
        para(0)
        # lines of the sender that only look like something else
        if rng.random() < 0.25:
            words, form = pick(texts).split(), rng.random()
            few, some, rest = " ".join(words[:3]), " ".join(words[2:5]), " ".join(words[5:])
            if form < 0.25:
                lines.append((f"{few} {pick(WROTE)}: {rest}", 0))
            elif form < 0.5:
                lines.append((f"-- {few} -- {rest}", 0))
            elif form < 0.75:
                lines.append((f"{pick(HEADER_LABELS)}: {some} {rest}", 0))
            elif phrases.notices:
                lines.append((f"{few} {' '.join(pick([x for x in phrases.notices]).split()[1:3])} {rest}", 0))
        if rng.random() < 0.12:
            lines.extend((f"- {' '.join(pick(texts).split()[:4])}", 0) for _ in range(2))
        if rng.random() < 0.15:
            blank()
            quote(rng.random() < 0.3)
            blank()
            para(0)
        blank()
    if rng.random() < 0.65:
        kind, own = rng.random(), rng.random() < unlisted
        words = pick(texts).rstrip(".").split()
        if kind < 0.25:
            lines.append((" ".join(words[: int(rng.integers(3, 7))]).rstrip(",") if own else pick(phrases.devices), 3))
        else:
            bye = " ".join(words[: int(rng.integers(1, 4))]).rstrip(",") if own else pick(phrases.closings)
            lines.append((bye + pick([",", ",", ""]), 2) if kind < 0.7 else (pick(["-- ", "--", "—", "***", "____"]), 2))
            lines.append((name() if rng.random() < 0.6 else name().split()[0], 2))
            for x in (pick(phrases.roles), f"Tel. +00 {int(rng.integers(100, 999))} {int(rng.integers(1000, 99999))}", "x.y@mail.example", f"{name()} | x.y@mail.example"):
                if rng.random() < 0.4:
                    lines.append((x, 2))
        blank()
    if rng.random() < 0.15:
        para(0, text=f"{pick(POSTSCRIPTS[:4])}: {pick(texts).split('. ')[0]}")
        blank()
    if rng.random() < 0.4 and phrases.notices:
        para(3, text=pick(phrases.notices))
        blank()
    tail = rng.random()
    if tail < 0.4:
        quote(True)
        if rng.random() < 0.2:
            blank()
            para(0)
    elif tail < 0.75:
        star = pick(["", "*"])
        head = rng.random()
        lines.append((pick([f"-----{pick(MARKERS)}-----", f"---------- {pick(MARKERS)} ---------", "_" * 32, "Begin forwarded message:"]), 1) if head < 0.85 else (f"{star}From:{star} {name()}", 1))
        if rng.random() < 0.2:
            blank()
        for a in pick([("From", "Sent", "To", "Subject"), ("Von", "Gesendet", "An", "Betreff"), ("De", "Envoyé", "À", "Objet"), ("De", "Enviado", "Para", "Asunto"), ("От", "Отправлено", "Кому", "Тема"), ("Từ", "Đã gửi", "Đến", "Chủ đề")]):
            lines.append((f"{star}{a}:{star} {name()}", 1))
        blank()
        for _ in range(int(rng.integers(1, 3))):
            para(1)
            if rng.random() < 0.4:
                blank()
        if rng.random() < 0.3:
            lines.extend([(pick(phrases.closings) + ",", 1), (name(), 1)])
    while lines and lines[-1][1] < 0:
        lines.pop()
    return "\n".join(x for x, _ in lines), [y for _, y in lines]


def train(samples: list[tuple[str, str]], messages: int = TRAINING_MESSAGES, passes: int = PASSES, seed: int = 5, phrases: Phrases | None = None) -> Model:
    """A message holds sentences and notices of one fold and is read with word weights of the other
    folds, as text nobody listed will be; the model keeps the weights of all."""
    phrases, rng = phrases or Phrases(), np.random.default_rng(seed)
    others = [t for _, t in samples]
    folds = []
    for k in range(FOLDS):
        own = [x for i, x in enumerate(samples) if i % FOLDS == k] or samples
        rest = [t for i, t in enumerate(others) if i % FOLDS != k] or others
        legal = legal_weights([x for i, x in enumerate(phrases.notices) if i % FOLDS != k], rest)
        folds.append((own, replace(phrases, notices=phrases.notices[k::FOLDS]), legal))
    made = []
    for n in range(messages):
        own, said, legal = folds[n % FOLDS]
        text, labels = compose(own, rng, said)
        m = parse(text, legal)
        if len(m.x) == 0 or m.header:
            continue
        y = [labels[k - 1] for k in m.numbers]
        spans, i = [], 0
        for j in range(1, len(y) + 1):
            if j == len(y) or y[j] != y[i]:
                spans.append((i, j, y[i]))
                i = j
        made.append((m, Sums.of(m), spans))
    legal = legal_weights(list(phrases.notices), others)
    model, mean = Model.empty(legal), Model.empty(legal)
    for _ in range(passes):
        for k in rng.permutation(len(made)):
            m, sums, spans = made[k]
            found = model.decode(m)
            if found != spans:
                model.learn(sums, spans, 1.0)
                model.learn(sums, found, -1.0)
            for a, b in ((mean.span, model.span), (mean.length, model.length), (mean.move, model.move)):
                a += b
    return mean


def learn(samples: DataFrame) -> Model:
    """From at most 400 labelled texts (language, text), lowest sample_id first; the rest is composed."""
    rows = samples.filter("lang is not null and text is not null").orderBy("sample_id").limit(400).select("lang", "text").collect()
    return train([(r.lang, r.text) for r in rows])


def line_labels(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(key, line_no, label) of every non-blank line; header and attachment lines have their own label.

    Lines are split at newline and counted from 1. Null and empty texts have no rows; a repeated
    row is labelled each time. No shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # some ten kB
    names = np.array([*LABELS, "header", "attachment"])
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, lines, labels = [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                if not t:
                    continue
                m = shared.value.parse(t)
                y = dict(zip(m.numbers.tolist(), shared.value.labels(m).tolist(), strict=True)) | dict.fromkeys(m.header, 4)
                for no, line in enumerate(t.split("\n"), 1):
                    if line.strip():
                        who.append(k)
                        lines.append(no)
                        labels.append(y.get(no, 5))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who, pa.int64())), pa.array(lines, pa.int64()), pa.array(names[np.array(labels, np.int64)].tolist(), pa.string())], names=[key, "line_no", "label"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind.simpleString()}, line_no long, label string")


def with_new_text(df: DataFrame, text: str, model: Model, out: str = "new_text", header: str = "header") -> DataFrame:
    """df with the sender's own text and the message's own header lines; null stays null.

    Blank lines between kept lines stay one. Existing columns of these names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<body:string,head:string>")
    def split(texts):
        import pandas as pd

        rows = []
        for t in texts:
            if t is None:
                rows.append((None, None))
                continue
            m, lines = shared.value.parse(t), t.split("\n")
            own = {int(n) for n, y in zip(m.numbers, shared.value.labels(m), strict=True) if y == 0}
            kept = [line.rstrip("\r") if no in own else "" for no, line in enumerate(lines, 1) if no in own or not line.strip()]
            rows.append((re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip("\n"), "\n".join(lines[k - 1] for k in m.header)))
        return pd.DataFrame(rows, columns=["body", "head"])

    kept = [c for c in df.columns if c not in (out, header)]
    return df.withColumn("__s", split(df[text])).select(*kept, F.col("__s.body").alias(out), F.col("__s.head").alias(header))
