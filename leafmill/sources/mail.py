"""E-mail: subject, header lines, the body once, attachments by name only."""

from __future__ import annotations

from email import message_from_bytes, policy

from leafmill.sources.base import Block, Document
from leafmill.sources.html import read_html
from leafmill.sources.text import paragraphs


def read_eml(data: bytes) -> Document:
    message = message_from_bytes(data, policy=policy.default)
    subject = str(message["subject"] or "")
    blocks = [Block("heading", subject, 1)] if subject else []
    head = [f"{n}: {message[n]}" for n in ("From", "To", "Cc", "Date") if message[n]]
    if head:
        blocks.append(Block("para", "\n".join(head)))
    body = message.get_body(preferencelist=("plain", "html"))
    if body is not None:
        content = body.get_content()
        blocks += read_html(content).blocks if body.get_content_type() == "text/html" else [Block("para", p) for p in paragraphs(content)]
    names = [part.get_filename() or "unnamed" for part in message.iter_attachments()]
    if names:
        blocks.append(Block("list", "Attachments: " + ", ".join(names)))
    return Document("eml", blocks, meta={"subject": subject, "from": str(message["from"] or ""), "date": str(message["date"] or ""), "attachments": len(names)})
