"""Remote files: a client contract, a standard-library client, a gateway.

Listing and landing happen on the driver; only landed files enter a plan.
"""

from __future__ import annotations

import ftplib
import os
import shutil
from collections.abc import Callable, Mapping
from pathlib import Path
from typing import Protocol

from .naming import NamingStrategy


class CouldNotConnect(ConnectionError):
    pass


class Client(Protocol):
    def list(self, path: str = "/") -> list[dict]: ...

    def download(self, dest: str, remote: str) -> None: ...

    def close(self) -> None: ...


class FtpClient:
    def __init__(self, session: ftplib.FTP) -> None:
        self._session = session

    @classmethod
    def connect(cls, host: str, on_error: Callable[[Exception, str], object] | None = None, factory: Callable[[str], ftplib.FTP] | None = None):
        """A client; on failure what ``on_error`` returns, or :class:`CouldNotConnect`."""
        try:
            session = (factory or ftplib.FTP)(host)
            session.login()
            return cls(session)
        except Exception as e:
            if on_error is not None:
                return on_error(e, host)
            raise CouldNotConnect(f"could not connect to {host}: {e}") from e

    def list(self, path: str = "/") -> list[dict]:
        return [{"name": n, "size": int(f.get("size", 0))} for n, f in self._session.mlsd(path) if f.get("type") != "dir"]

    def download(self, dest: str, remote: str) -> None:
        """Lands a file unless it is there; a broken transfer leaves none."""
        if Path(dest).exists():
            return
        part = f"{dest}.part"
        with open(part, "wb") as out:
            self._session.retrbinary(f"RETR {remote}", out.write)
        os.replace(part, dest)

    def close(self) -> None:
        self._session.quit()


class FolderClient:
    """A folder of this machine in the place of a remote one."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def list(self, path: str = "/") -> list[dict]:
        return [{"name": p.name, "size": p.stat().st_size} for p in sorted(Path(self.folder).iterdir()) if p.is_file()]

    def download(self, dest: str, remote: str) -> None:
        if not Path(dest).exists():
            shutil.copyfile(Path(self.folder) / Path(remote).name, f"{dest}.part")
            os.replace(f"{dest}.part", dest)

    def close(self) -> None:
        pass


class Gateway:
    """Files of one remote folder, selected by a naming strategy."""

    def __init__(self, client: Client, path: str, strategy: NamingStrategy) -> None:
        self.client, self.path, self.strategy = client, path, strategy

    def list(self, subset: Mapping, display: str = "full") -> list:
        """Entries (``full``) or names (``short``), prefix by prefix in listing order."""
        listing = self.client.list(self.path)
        chosen = [e for p in self.strategy.prefixes(subset) for e in listing if e["name"].startswith(p)]
        return [e["name"] for e in chosen] if display == "short" else chosen

    def get(self, file: str, dest: str | None = None) -> None:
        self.client.download(dest or file, self.path + file)
