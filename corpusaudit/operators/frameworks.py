"""Front-end frameworks, libraries and component counts of projects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.functions import text as tx
from corpusaudit.operators.classify import manifest_json
from corpusaudit.operators.joins import first_by, join_per_corpus

# Marker dependency -> name, in order of preference.
FRAMEWORKS = {
    "nuxt": "nuxt", "@nuxt/core": "nuxt", "next": "next", "react": "react", "react-dom": "react", "vue": "vue",
    "@angular/core": "angular", "svelte": "svelte", "solid-js": "solid",
}
STATE_LIBRARIES = {
    "vuex": "vuex", "pinia": "pinia", "@reduxjs/toolkit": "redux-toolkit", "redux": "redux", "zustand": "zustand",
    "recoil": "recoil", "jotai": "jotai", "mobx": "mobx", "@ngrx/store": "ngrx",
}
UI_LIBRARIES = {
    "ant-design-vue": "ant-design-vue", "antd": "antd", "element-ui": "element-ui", "element-plus": "element-plus",
    "vuetify": "vuetify", "@mui/material": "material-ui", "@material-ui/core": "material-ui",
    "chakra-ui": "chakra-ui", "@chakra-ui/react": "chakra-ui", "tailwindcss": "tailwindcss",
    "@headlessui/react": "headlessui", "bootstrap": "bootstrap", "react-bootstrap": "react-bootstrap",
    "primevue": "primevue", "quasar": "quasar", "naive-ui": "naive-ui",
}
ROUTER_FILES = [
    "src/router/index.ts", "src/router/index.js", "src/router.ts", "src/router.js", "app/router.ts", "app/router.js",
]
PAGE_DIRS, COMPONENT_DIRS, STORE_DIRS = ["pages", "views", "screens", "routes"], ["components"], ["store", "stores", "state"]
EXTENSIONS = {"vue": "vue", "react": "jsx|tsx", "svelte": "svelte", "angular": r"component\.ts", None: "vue|jsx|tsx|svelte"}


def _first_marker(deps: Column, markers: dict[str, str]) -> Column:
    """First marker present in a dependency map: the marker, its name and the version asked for."""
    hits = [
        F.when(F.map_contains_key(deps, m), F.struct(F.lit(m).alias("marker"), F.lit(n).alias("name"))) for m, n in markers.items()
    ]
    return F.coalesce(*hits)


def detect(packages: DataFrame) -> DataFrame:
    """Framework, version and libraries of each package file; other columns but ``content`` are kept.

    A package file is one row and the marker lists are fixed, so markers are looked up in the row's map:
    no dependency is exploded and nothing is shuffled.
    """
    keep = [c for c in packages.columns if c != "content"]
    empty = F.create_map().cast("map<string,string>")
    part = lambda k: F.coalesce(F.col("pkg")[k], empty)
    # of equal names the later map wins
    merged = lambda *maps: reduce(
        lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b), maps
    )
    df = packages.withColumn("pkg", manifest_json(F.col("content"))).withColumn(
        "own", merged(part("dependencies"), part("devDependencies"))
    )
    df = df.withColumn("deps", merged(F.col("own"), part("peerDependencies")))
    df = df.withColumn("fw", _first_marker(F.col("deps"), FRAMEWORKS))
    get = lambda k: F.try_element_at("deps", F.lit(k))
    name = F.col("fw.name")
    version = (
        F.when(name.isin("nuxt", "next"), F.try_element_at(F.col("deps"), F.col("fw.marker")))
        .when(name == "vue", get("vue"))
        .when(name == "react", F.coalesce(get("react"), get("react-dom")))
        .when(name == "angular", get("@angular/core"))
        .when(name == "svelte", get("svelte"))
        .when(name == "solid", get("solid-js"))
    )
    label = F.when(name.isin("nuxt", "vue"), F.concat(name, tx.major_version(version))).when(name == "next", "nextjs").otherwise(name)
    return df.select(
        *keep,
        label.alias("framework"),
        tx.clean_version(version).alias("framework_version"),
        _first_marker(F.col("own"), UI_LIBRARIES)["name"].alias("ui_library"),
        _first_marker(F.col("own"), STATE_LIBRARIES)["name"].alias("state_management"),
    )


def _family(framework: Column) -> Column:
    return (
        F.when(framework.rlike("vue|nuxt"), "vue")
        .when(framework.isin("react", "nextjs"), "react")
        .when(framework.isin("svelte", "angular"), framework)
    )


def frontends(files: DataFrame) -> DataFrame:
    """One row per corpus with a front end: framework, libraries, router type, page/store/component counts."""
    found = detect(files.where(F.col("path") == "package.json").select("corpus", "content")).where(
        F.col("framework").isNotNull()
    )
    path = F.col("path")
    family = _family(F.col("framework"))

    def counted(dirs: list[str], endings: dict[str | None, str]) -> Column:
        """Files below the folders with the endings of the family; literal patterns, compiled once."""
        hit = F.lit(False)
        for name, ending in endings.items():
            mine = family.isNull() if name is None else family == name
            below = rf"^(src/|app/)?({'|'.join(dirs)})/([^./][^/]*/)*[^/]*\.({ending})$"
            hit = hit | (F.coalesce(mine, F.lit(False)) & path.rlike(below))
        return F.count_if(hit)

    scripts = {k: "ts|js" for k in EXTENSIONS}
    code = files.select("corpus", "path").where(path.rlike(r"\.(vue|jsx|tsx|svelte|ts|js)$"))
    # framework first, so that counting needs one pass over the paths
    with_fw = join_per_corpus(code, found.select("corpus", "framework"), ["path"], "inner")
    counts = with_fw.groupBy("corpus").agg(
        counted(PAGE_DIRS, EXTENSIONS).alias("page_count"),
        counted(STORE_DIRS, scripts).alias("store_count"),
        counted(COMPONENT_DIRS, EXTENSIONS).alias("component_count"),
        F.bool_or(path.isin(ROUTER_FILES)).alias("has_router_file"),
    )
    router = F.when(F.col("framework").rlike("nuxt|next"), "file-based").when(F.col("has_router_file"), "config-based")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return found.join(counts, "corpus", "left").select(
        "corpus",
        "framework",
        "framework_version",
        "ui_library",
        "state_management",
        router.alias("router_type"),
        zero("page_count"),
        zero("store_count"),
        zero("component_count"),
    )


def first_method(*detections: DataFrame) -> DataFrame:
    """Union of detections in order of preference; of equal (corpus, path) the first method is kept."""
    ranked = [d.withColumn("_rank", F.lit(i)) for i, d in enumerate(detections)]
    both = reduce(DataFrame.unionByName, ranked)
    take = [c for c in both.columns if c not in ("corpus", "path", "_rank")]
    return first_by(both, ["corpus", "path"], F.col("_rank"), take)
