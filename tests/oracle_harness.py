"""Run registered queries in Spark and their SQL oracles in DuckDB and compare
row count, column names and the multiset of rows (order-insensitive)."""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
                 "float": "FLOAT", "smallint": "SMALLINT"}


def _norm(v):
    if isinstance(v, float) and v != v:
        return "NaN"
    return v


def compare(spark, sf_dir: str, names=None, verbose=True):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E

    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            srows = [tuple(_norm(x) for x in r) for r in sdf.collect()]
            scols = sdf.columns
            stypes = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
        except Exception as e:  # noqa: BLE001
            out[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            if verbose:
                print(name, out[name], flush=True)
            continue
        ts = time.time() - t0
        if name not in sqls:
            out[name] = f"rows-only {len(srows)}"
            if verbose:
                print(f"{name:28s} {out[name]}  spark {ts:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(sqls[name])
            dcols = [d[0] for d in cur.description]
            dtypes = {d[0]: str(d[1]) for d in cur.description}
            drows = [tuple(_norm(x) for x in r) for r in cur.fetchall()]
        except Exception as e:  # noqa: BLE001
            out[name] = f"DUCK ERROR {str(e)[:300]}"
            if verbose:
                print(name, out[name], flush=True)
            continue
        ok = True
        msg = []
        if sorted(scols) != sorted(dcols):
            ok = False
            msg.append(f"cols spark={scols} duck={dcols}")
        if sorted(scols) == sorted(dcols):
            bad_t = [(c, stypes[c], dtypes[c]) for c in scols
                     if SPARK_TO_DUCK.get(stypes[c], stypes[c]) != dtypes[c]]
            if bad_t:
                ok = False
                msg.append(f"types {bad_t}")
        if len(srows) != len(drows):
            ok = False
            msg.append(f"rows spark={len(srows)} duck={len(drows)}")
        if ok:
            order = sorted(range(len(scols)), key=lambda i: scols[i])
            dorder = [dcols.index(scols[i]) for i in order]
            key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
            sa = sorted((tuple(r[i] for i in order) for r in srows), key=key)
            da = sorted((tuple(r[i] for i in dorder) for r in drows), key=key)
            bad = [(a, b) for a, b in zip(sa, da) if a != b]
            if bad:
                ok = False
                msg.append(f"{len(bad)} rows differ, e.g. spark={bad[0][0]} duck={bad[0][1]}")
        out[name] = "OK" if ok else "MISMATCH " + "; ".join(msg)
        if verbose:
            print(f"{name:28s} {out[name][:400]}  rows={len(srows)} spark {ts:.1f}s", flush=True)
    return out


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from tickstat.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    res = compare(local_session(), sf, names)
    bad = {k: v for k, v in res.items() if not (v == "OK" or v.startswith("rows-only"))}
    print(f"{len(res) - len(bad)}/{len(res)} ok")
