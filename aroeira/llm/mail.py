"""The new text of a mail message: parts decoded, quotes and furniture taken away.

Pure Python, run inside Arrow batches.  Defined results: a null, empty or blank
message has no new text; a message without headers is all body; a part whose
encoding is broken is decoded as far as it goes; attachments are never read.
"""

from __future__ import annotations

import binascii
import html
import quopri
import re
import sys

_HEADER = re.compile(r"[!-9;-~]+:")
_PARAM = re.compile(r"""boundary\s*=\s*(?:"([^"]*)"|([^\s;]+))""", re.I)
_CHARSET = re.compile(r"""charset\s*=\s*"?([^"\s;]+)""", re.I)
_TAG_BREAK = re.compile(r"<(?:br|/p|/div|/li|/tr|/h\d|p|div|li|tr|hr|h\d)\b[^>]*>", re.I)
_TAG_QUOTE = re.compile(r"<blockquote\b.*?</blockquote>", re.I | re.S)
_TAG_SKIP = re.compile(r"<(style|script|head)\b.*?</\1>", re.I | re.S)
_TAG = re.compile(r"<[^<>]*>")
_MOJIBAKE = re.compile("[ÃÂ][\x80-\xbf]")


def headers(block: str) -> dict[str, str]:
    """First value of each header, folded lines joined, names in lower case."""
    out: dict[str, str] = {}
    name = ""
    for line in block.split("\n"):
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif _HEADER.match(line):
            name, _, value = line.partition(":")
            name = name.lower()
            if name in out:
                name = ""
            else:
                out[name] = value.strip()
        else:
            name = ""
    return out


def _decoded(body: str, encoding: str, charset: str) -> str:
    if encoding == "base64":
        clean = re.sub(r"[^A-Za-z0-9+/]", "", body)
        data = binascii.a2b_base64(clean[: len(clean) // 4 * 4] + (clean[len(clean) // 4 * 4 :] + "===")[:4] if len(clean) % 4 > 1 else clean[: len(clean) // 4 * 4])
    elif encoding == "quoted-printable":
        data = quopri.decodestring(body.encode("utf-8", "replace"))
    else:
        return body
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252" if charset.startswith(("windows", "cp")) else "latin-1", "replace")


def _plain(markup: str) -> str:
    s = _TAG_QUOTE.sub("\n", _TAG_SKIP.sub(" ", markup))
    s = re.sub(r"[ \t]*\n[ \t]*", "\n", s)
    s = re.sub(r"<br\b[^>]*>\n", "\n", s, flags=re.I)
    return html.unescape(_TAG.sub("", _TAG_BREAK.sub("\n", re.sub(r"</p>\s*<p\b[^>]*>", "\n\n", s, flags=re.I))))


def split_message(text: str) -> tuple[dict[str, str], str]:
    """Headers and body of a message or part."""
    if text.startswith("From "):
        text = text.partition("\n")[2]
    if not _HEADER.match(text):
        return {}, text.removeprefix("\n")
    head, _, body = text.partition("\n\n")
    return headers(head), body


def readable(text: str, depth: int = 0) -> str:
    """The text parts of a message, decoded; of alternatives the plain one.

    Parts may be nested as deep as the text is long.
    """
    if not depth and (deep := text.lower().count("boundary") + 200) * 3 > sys.getrecursionlimit():
        sys.setrecursionlimit(3 * deep)  # frames of Python functions are not on the C stack
    head, body = split_message(text)
    kind = head.get("content-type", "text/plain")
    base = kind.partition(";")[0].strip().lower()
    if base.startswith("multipart/") :
        m = _PARAM.search(kind)
        if m and (boundary := m[1] or m[2]) and f"--{boundary}" in body:
            mark = rf"(?:\A|\n)--{re.escape(boundary)}"
            body = re.split(rf"{mark}--[ \t]*(?=\n|\Z)", body, maxsplit=1)[0]
            pieces = re.split(rf"{mark}[ \t]*(?=\n|\Z)", body)[1:]
            parts = [p.removeprefix("\n") for p in pieces]
            parts = [p for p in parts if p.strip()]
            read = [(split_message(p)[0].get("content-type", "text/plain").lower(), p) for p in parts]
            if base == "multipart/alternative":
                for want in ("text/plain", "multipart/", "text/html"):
                    for k, p in read:
                        if k.startswith(want) and (t := readable(p, depth + 1)).strip():
                            return t
                return ""
            texts = [readable(p, depth + 1) for _, p in read]
            return "\n\n".join(texts)
    if depth and ("attachment" in head.get("content-disposition", "").lower() or not base.startswith("text/") or base == "text/csv"):
        return ""
    c = _CHARSET.search(kind)
    body = _decoded(body, head.get("content-transfer-encoding", "").strip().lower(), (c[1] if c else "").lower())
    if base == "text/html" or not depth and re.match(r"\s*<html\b", body, re.I):
        body = _plain(body)
    return body.replace("\r\n", "\n").replace("\r", "\n")


def repaired(text: str) -> str:
    """UTF-8 that was once read as Latin-1 turned back, where it turns back whole lines."""
    if not _MOJIBAKE.search(text):
        return text
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if _MOJIBAKE.search(line):
            for codec in ("latin-1", "cp1252"):
                try:
                    lines[i] = line.encode(codec).decode("utf-8")
                    break
                except UnicodeError:
                    continue
    return "\n".join(lines)


_QUOTED = re.compile(r"\s*(?:[^\W\d_]{1,3})?[>|]")
_ATTRIBUTION = re.compile(r"(?:\b(?:escreveu|wrote|escribió)\b[^.!?]{0,80}:)\s*$")
_SEPARATOR = re.compile(r"\s*(?:-{3,}\s*(?:mensagem|mensaje|original|forwarded|begin)\b.*|_{16,}\s*$)", re.I)
_FIELD = re.compile(r"\s*(?:de|from|para|to|cc|data|date|fecha|enviad[ao](?: em| el)?|sent|assunto|asunto|subject)\s*:", re.I)
_SIGNED = re.compile(
    r"\s*(?:--\s*$|(?:att|abs|abraços|atenciosamente|cordialmente|grat[oa]|saludos|un saludo|atentamente|cordiales saludos|regards|kind regards|best regards|best|cheers|sincerely|thanks|obrigad[oa]|gracias)[.,!]?\s*$)",
    re.I,
)
_RULE = re.compile(r"\s*(?:-{8,}|\*{8,}|={8,}|#{8,}|~{8,})\s*$")
_NOTICE = re.compile(
    r"\s*(?:confidencial|confidential|confidencialidade?\b|aviso\b|disclaimer|notice\b|esta mensagem e seus|this message and its|este mensaje y sus|nothing in this message|este texto não constitui|nada (?:de|en) este|este texto no constituye|antes de imprimir|please consider the environment)",
    re.I,
)
_GREETING = re.compile(
    r"\s*(?:(?:oi|olá|ola|bom dia|boa tarde|boa noite|prezad[oa](?:\(a\))?s?|car[oa](?:\(a\))?s?|hola|buenas|buenos días|estimad[oa]s?|hi|hello|dear|good morning)\b[^.?!]{0,40}|[A-ZÀ-Ý][\wÀ-ÿ]+(?: [A-ZÀ-Ý][\wÀ-ÿ]+)?\s*)[,:\-–]\s*$",
    re.I,
)


def own_lines(body: str) -> list[str]:
    """Lines of the writer's own text; an empty line where a paragraph ends."""
    lines = body.split("\n")
    kept: list[str] = []
    i, n = 0, len(lines)
    signed = False
    while i < n:
        line = lines[i]
        if _QUOTED.match(line):
            kept.append("")
            signed = False
            i += 1
            continue
        separator = _SEPARATOR.match(line)
        if separator or _ATTRIBUTION.search(line):
            i += 1
            while i < n and (not lines[i].strip() or separator and _FIELD.match(lines[i])):
                i += 1
            kept.append("")
            signed = False
            if i < n and not _QUOTED.match(lines[i]) and not (_SEPARATOR.match(lines[i]) or _ATTRIBUTION.search(lines[i])):
                break  # quoted without marks: nothing below it can be told apart
            continue
        if signed:
            i += 1
            continue
        if _SIGNED.match(line) or _RULE.match(line):
            signed = True
        elif not line.strip():
            kept.append("")
        elif _NOTICE.match(line):
            while i < n and lines[i].strip() and not _QUOTED.match(lines[i]):
                i += 1
            kept.append("")
            continue
        elif not ((not kept or not kept[-1]) and _GREETING.match(line)):
            kept.append(line.strip())
        i += 1
    return kept


_END = re.compile(r"(?<=[.!?])[\"')\]]*\s+")


def sentences(text: str | None) -> list[str]:
    """The sentences of a message's new text."""
    if not text or not text.strip():
        return []
    body = repaired(readable(text.replace("\r\n", "\n").replace("\r", "\n")))
    out: list[str] = []
    for paragraph in "\n".join(own_lines(body)).split("\n\n"):
        joined = " ".join(paragraph.split())
        if joined:
            out += [s for s in _END.split(joined) if s]
    return out
