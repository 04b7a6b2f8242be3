"""Command line: ``python -m deltaweave COMMAND ...``

diff OLD NEW OUT, patch OLD DIFF OUT, test OLD NEW DIFF and info DIFF work on
files; dirdiff OLD NEW OUT, dirpatch OLD DIFF OUT, manifest DIR OUT and verify
DIR MANIFEST on directories, with Spark.
"""

from __future__ import annotations

import argparse
import os
import sys
import tempfile

from .functions import formats, kernels
from .operators.pairs import FINDERS
from .options import DiffOptions, block_size_for, parse_size


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _write(path: str, data: bytes) -> None:
    """Write next to the target, then put it in place."""
    handle, made = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(handle, "wb") as file:
        file.write(data)
    os.replace(made, path)


def make_diff(old: bytes, new: bytes, options: DiffOptions) -> bytes:
    """A container, checked by applying it."""
    if options.refuse_equal and old == new:
        raise ValueError("old and new are equal")
    a, b = kernels.as_array(old), kernels.as_array(new)
    covers = FINDERS[options.finder](a, b, block_size_for(len(a), options.block_size))
    data = formats.encode(options.kind, a, b, covers, options.packing)
    if options.verify and formats.decode(a, data, len(b)) != new:
        raise ValueError("the diff does not give the new data")
    return data


def _session():  # noqa: ANN202
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("deltaweave").getOrCreate()


def _dir_diff(args: argparse.Namespace) -> None:
    from .plans import directory
    from .sources.manifests import scan_directory

    spark = _session()
    sides = [scan_directory(spark, d, args.ignore).where("NOT is_dir").select("path", "content") for d in (args.new, args.old)]
    directory.dir_diff(*sides, args.kind, args.packing).write.mode("errorifexists").parquet(args.out)


def _dir_patch(args: argparse.Namespace) -> None:
    from .plans import directory
    from .sources.manifests import scan_directory

    spark = _session()
    old = scan_directory(spark, args.old).where("NOT is_dir").select("path", "content")
    made = directory.dir_patch(spark.read.parquet(args.diff), old)
    if made.where("NOT coalesce(ok, FALSE)").take(1):
        raise ValueError("a file has another digest")
    for row in made.toLocalIterator():
        path = os.path.join(args.out, row["path"])
        if os.path.relpath(path, args.out).startswith(".."):
            raise ValueError("a path leaves the directory")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        _write(path, bytes(row["content"]))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="deltaweave", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, places in {"diff": "old new out", "patch": "old diff out", "test": "old new diff", "info": "diff", "resave": "diff out", "dirdiff": "old new out", "dirpatch": "old diff out", "manifest": "dir out", "verify": "dir manifest"}.items():
        command = commands.add_parser(name)
        for place in places.split():
            command.add_argument(place)
        if name in ("diff", "dirdiff", "resave"):
            command.add_argument("--kind", default="steps", choices=sorted(set(formats.ENCODE) - {"plain"}))
            command.add_argument("--packing", default="zlib")
            command.add_argument("--finder", default="block", choices=sorted(FINDERS))
            command.add_argument("--block", default="64", type=parse_size)
            command.add_argument("--refuse-equal", action="store_true")
        if name in ("dirdiff", "manifest"):
            command.add_argument("--ignore", default="")
        if name == "manifest":
            command.add_argument("--checksum", default="sha256")
    args = parser.parse_args(argv)
    try:
        if args.command == "diff":
            options = DiffOptions(args.kind, args.packing, args.finder, args.block, refuse_equal=args.refuse_equal)
            _write(args.out, make_diff(_read(args.old), _read(args.new), options))
        elif args.command == "patch":
            _write(args.out, formats.decode(kernels.as_array(_read(args.old)), _read(args.diff)))
        elif args.command == "test":
            same = formats.decode(kernels.as_array(_read(args.old)), _read(args.diff)) == _read(args.new)
            print("same" if same else "different")
            return int(not same)
        elif args.command == "info":
            print(formats.info(_read(args.diff)))
        elif args.command == "resave":
            _write(args.out, formats.resave_sections(_read(args.diff), args.packing))
        elif args.command == "dirdiff":
            _dir_diff(args)
        elif args.command == "dirpatch":
            _dir_patch(args)
        elif args.command == "manifest":
            from .sources.manifests import save_manifest, scan_directory

            save_manifest(scan_directory(_session(), args.dir, args.ignore), args.out, args.checksum)
        else:
            from .sources.manifests import load_manifest, scan_directory, verify_manifest

            spark = _session()
            bad = verify_manifest(scan_directory(spark, args.dir), load_manifest(spark, args.manifest)).where("state <> 'ok'").orderBy("path").collect()
            for row in bad:
                print(row["state"], row["path"])
            return int(bool(bad))
    except ValueError as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
