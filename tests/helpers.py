"""Literal documents for the scenarios."""

from fleetfold import schema as S

MAIN, SIDE = S.EXECUTOR_CONTAINER, "sidecar"


def container(name=MAIN, exit_code=None, running=False, reason=None, waiting=None):
    return {
        "name": name, "image": "img",
        "running": {"started_at": "t0"} if running else None,
        "terminated": None if exit_code is None else
        {"started_at": "t0", "finished_at": "t1", "exit_code": exit_code, "reason": reason},
        "waiting": None if waiting is None else {"reason": waiting},
    }


def pod(exec_id=1, phase="Running", containers=(), app="a", seq=None, **more):
    row = {f.name: None for f in S.POD.fields}
    row.update(
        app_id=app, exec_id=exec_id, profile_id=0, seq=exec_id if seq is None else seq, ts_ms=0,
        name=f"{app}-exec-{exec_id}", namespace="default", uid=f"{app}-{exec_id}-{seq}",
        labels={S.ROLE_LABEL: S.EXECUTOR_ROLE, S.ID_LABEL: str(exec_id)},
        phase=phase, containers=None if containers is None else list(containers), restart_policy="Never",
    )
    row.update(more)
    return row


def pods(spark, *rows):
    return spark.createDataFrame([tuple(r[f.name] for f in S.POD.fields) for r in rows], S.POD)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
