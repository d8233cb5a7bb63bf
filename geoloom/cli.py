"""Command line: tile, mvt, build, serve, info."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from geoloom import api, config


def _source_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--input", required=True)
    p.add_argument("--outdir", required=True)
    for name in ("--sort", "--compression", "--geom-col", "--csv-x-col", "--csv-y-col", "--csv-wkt-col", "--src-crs", "--partition-size", "--csv-split-size"):
        p.add_argument(name)
    p.add_argument("--histogram-dtype", "--dtype", dest="histogram_dtype")
    for name in ("--sample-cap", "--grid-size", "--sfc-bits", "--seed"):
        p.add_argument(name, type=int)
    p.add_argument("--sample-ratio", type=float)
    p.add_argument("--covering-bbox", action=argparse.BooleanOptionalAction, default=None)


def _mvt_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--zoom", type=int)
    p.add_argument("--threshold", type=float)
    p.add_argument("--pmtiles", action=argparse.BooleanOptionalAction, default=None)
    p.add_argument("--pmtiles-compression", choices=["gzip", "zstd", "none"])
    for name in ("--feature-capacity", "--extent", "--buffer"):
        p.add_argument(name, type=int)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="geoloom", description="Partition, query and draw spatial datasets.")
    p.add_argument("--config", help="settings file")
    p.add_argument("--log-level")
    sub = p.add_subparsers(dest="command", required=True)
    _source_options(sub.add_parser("tile", help="partition a source into GeoParquet tiles"))
    mvt = sub.add_parser("mvt", help="make vector tiles of a dataset")
    mvt.add_argument("--dir", required=True)
    mvt.add_argument("--outdir")
    _mvt_options(mvt)
    build = sub.add_parser("build", help="both")
    _source_options(build)
    _mvt_options(build)
    serve = sub.add_parser("serve", help="serve a folder of datasets over HTTP")
    serve.add_argument("--dir", required=True)
    serve.add_argument("--host")
    serve.add_argument("--port", type=int)
    serve.add_argument("--cache-size", type=int)
    info = sub.add_parser("info", help="what a dataset holds")
    info.add_argument("--dir", required=True)
    return p


def main(args: list[str] | None = None) -> int:
    a = vars(parser().parse_args(args))
    config.use_file(a.pop("config"))
    command = a.pop("command")
    logging.basicConfig(level=str(config.resolve(command, "log_level", a.pop("log_level"))).upper())
    given = {k: v for k, v in a.items() if v is not None}
    if command == "tile":
        print(json.dumps(vars(api.tile(**given)), default=str))
    elif command == "mvt":
        print(json.dumps(vars(api.generate_mvt(given.pop("dir"), **given)), default=str))
    elif command == "build":
        tiles, mvt, archive = api.build(**given)
        print(json.dumps({"tiles": vars(tiles), "mvt": vars(mvt), "pmtiles": archive}, default=str))
    elif command == "serve":
        from geoloom.serving import serve

        get = lambda k: config.resolve("serve", k, given.get(k))
        serve(given["dir"], get("host"), int(get("port")), cache_size=int(get("cache_size")), extent=int(get("extent")))
    else:
        print(json.dumps(api.get_dataset_metadata(given["dir"]), indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
