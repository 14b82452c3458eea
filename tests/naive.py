"""An independent in-memory version of the line format, sharing nothing with the engine."""

LIMIT = 2**63


def records(data: bytes) -> list[bytes]:
    if data[:3] == b"\xef\xbb\xbf":
        data = data[3:]
    parts = data.split(b"\n")
    tail = parts.pop()
    out = [p[:-1] if p.endswith(b"\r") else p for p in parts]
    tail = tail[:-1] if tail.endswith(b"\r") else tail
    return [*out, tail] if tail else out


def key(line: bytes):
    head, dot, rest = line.partition(b".")
    digits = head[1:] if head[:1] in (b"+", b"-") else head
    if not dot or not digits or any(not 48 <= c <= 57 for c in digits):
        return None
    number = int(head)
    if not -LIMIT <= number < LIMIT:
        return None
    return (rest[1:] if rest[:1] == b" " else rest, number, line)


def sort(data: bytes) -> bytes:
    return b"".join(x + b"\n" for x in sorted(records(data), key=key))


def fnv(line: bytes) -> int:
    h = 14695981039346656037
    for b in line:
        h = (h ^ b) * 1099511628211 % 2**64
    return h
