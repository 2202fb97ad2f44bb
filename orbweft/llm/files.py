"""Files that tasks write beside a table: shards, archives and their indexes."""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a uri and the path within it; Hadoop's names of object stores are taken too."""
    for hadoop in ("s3a://", "s3n://"):
        if uri.startswith(hadoop):
            uri = "s3://" + uri[len(hadoop) :]
    return pafs.FileSystem.from_uri(uri)


class Draft:
    """A file written under a name of its own and moved to its uri at the end; a task that runs again replaces it."""

    def __init__(self, uri: str):
        self.uri = uri
        self.fs, self.path = open_fs(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.own)

    def __enter__(self):
        return self.out

    def __exit__(self, kind, *_):
        if kind is None:
            self.publish()
        else:
            self.abandon()

    def abandon(self) -> None:
        self.out.close()
        self.fs.delete_file(self.own)

    def publish(self) -> None:
        self.out.close()
        try:
            self.fs.move(self.own, self.path)
        except OSError:  # some systems do not replace
            self.fs.delete_file(self.path)
            self.fs.move(self.own, self.path)


def publish(uri: str, write) -> str:
    """Have write(stream) fill the file at uri."""
    with Draft(uri) as out:
        write(out)
    return uri
