"""Connection strings: Provider=File|Memory|Network;name=value;..."""

from __future__ import annotations

from dataclasses import dataclass

# Names (any case, spaces ignored) that say the path of a file, and the host of a server.
PATH_NAMES = ("path", "file", "filename", "datasource")
HOST_NAMES = ("host", "server", "address")


@dataclass(frozen=True)
class Connection:
    provider: str  # file, memory or network
    settings: dict[str, str]

    @property
    def path(self) -> str:
        found = next((self.settings[n] for n in PATH_NAMES if n in self.settings), None)
        if not found:
            raise ValueError("a path is needed: Path=...")
        return found


def _pairs(text: str):
    part, quote = "", ""
    for c in text + ";":
        if quote:
            quote = "" if c == quote else quote
            part += c
        elif c in "\"'":
            quote = c
            part += c
        elif c == ";":
            if part.strip():
                name, equals, value = part.partition("=")
                if not equals:
                    raise ValueError(f"{part.strip()!r} is not name=value")
                value = value.strip()
                if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
                    value = value[1:-1]
                yield name.strip().lower().replace(" ", ""), value
            part = ""
        else:
            part += c
    if quote:
        raise ValueError("unclosed quote")


def parse(text: str) -> Connection:
    """Without a provider it follows from what is there: a host means a network, a path a file, else memory."""
    settings = dict(_pairs(text))
    provider = settings.pop("provider", "").lower()
    if not provider:
        provider = "network" if any(n in settings for n in HOST_NAMES) else "file" if any(n in settings for n in PATH_NAMES) else "memory"
    if provider not in ("file", "memory", "network"):
        raise ValueError(f"unknown provider {provider!r}")
    return Connection(provider, settings)
