"""Facets, their domains and the narrowing of these by search hits."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from tesserae.vocabulary import ACTIVITIES, FREQUENCIES, INSTITUTIONS


@dataclass(frozen=True)
class Facet:
    name: str
    multi: bool = False
    domain: tuple[str, ...] = ()
    descriptions: dict[str, str] = field(default_factory=dict)
    default: str | None = None
    meaning: str = ""
    #: The name by which requests may ask for what follows the last '-' of a value.
    last_part: str | None = None


@dataclass(frozen=True)
class FacetSchema:
    """Ordered facets; the first is the entity that profiles are made for."""

    facets: tuple[Facet, ...]

    @property
    def entity(self) -> Facet:
        return self.facets[0]

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.facets]

    def __getitem__(self, name: str) -> Facet:
        for f in self.facets:
            if f.name == name:
                return f
        raise KeyError(f"no facet {name!r}; there are {', '.join(self.names)}")

    def __contains__(self, name: str) -> bool:
        return name in self.names

    def asked_by(self, name: str) -> Facet | None:
        """The facet that a request may name so: by its own name, or by that of its last part."""
        return next((f for f in self.facets if name in (f.name, f.last_part)), None)

    def struct(self) -> T.StructType:
        kind = lambda f: T.ArrayType(T.StringType()) if f.multi else T.StringType()
        return T.StructType([T.StructField(f.name, kind(f), True, {"domain": list(f.domain), "default": f.default, "meaning": f.meaning}) for f in self.facets])

    def vocabulary(self) -> list[tuple[str, str, str, int]]:
        """(facet, value, description, ord) of every value that a domain states."""
        return [(f.name, v, f.descriptions.get(v, ""), i) for f in self.facets for i, v in enumerate(f.domain)]

    def described(self, rows: list[tuple[str, str, str]]) -> FacetSchema:
        """With descriptions from a vocabulary's (facet, value, description) rows."""
        by: dict[str, dict[str, str]] = {}
        for name, value, text in rows:
            by.setdefault(name, {})[value] = text
        return FacetSchema(tuple(replace(f, descriptions={**f.descriptions, **by.get(f.name, {})}) for f in self.facets))

    def narrowed(self, relevant: list[str], hits: dict[str, list[tuple[str, str]]] | None = None) -> FacetSchema:
        """The relevant facets; an open one takes the names of its hits as its domain. Of a repeated name the last description stands."""
        out = []
        for name in relevant:
            f = self[name]
            found = [(n, d) for n, d in (hits or {}).get(name, []) if n]
            if found and not f.domain:
                f = replace(f, domain=tuple(dict.fromkeys(n for n, _ in found)), descriptions=dict(found))
            out.append(f)
        return FacetSchema(tuple(out))

    def json(self) -> str:
        return self.struct().json()


#: Domains of the climate archive's facets (fixed values); those with descriptions are in vocabulary.py.
RESOLUTION = ("100 km", "250 km", "500 km", "50 km", "1x1 degree", "200 km", "25 km", "10000 km", "10 km", "2x2 degree")
REALM = ("aerosol", "atmos", "atmosChem", "land", "landIce", "ocean", "ocnBgchem", "seaIce")

#: The facets that a catalogue record of the archive has, the entity first.
CLIMATE_FACETS = FacetSchema((
    Facet("source_id", True, meaning="model that made the data"),
    Facet("frequency", True, tuple(FREQUENCIES), FREQUENCIES, meaning="how often values stand, from sub-hourly to decadal"),
    Facet("nominal_resolution", True, RESOLUTION, meaning="horizontal resolution, about"),
    Facet("experiment_id", True, meaning="experiment"),
    Facet("variable_id", True, meaning="variable"),
    Facet("sub_experiment_id", True, meaning="start year of a hindcast, or none"),
    Facet("activity_id", True, tuple(ACTIVITIES), ACTIVITIES, meaning="project within the archive"),
    Facet("realm", True, REALM, meaning="part of the climate system"),
    Facet("institution_id", True, tuple(INSTITUTIONS), INSTITUTIONS, meaning="institution"),
    Facet("table_id", True, meaning="table of variables"),
    Facet("member_id", True, default="r1i1p1f1", meaning="ensemble member", last_part="variant_label"),
    Facet("grid_label", True, meaning="grid"),
))
#: The facets that requests may name: as above, with the variant in place of table, member and grid.
REQUEST_FACETS = FacetSchema((*CLIMATE_FACETS.facets[:9], Facet("variant_label", default="r1i1p1f1", meaning="ensemble variant")))
#: The facet that each component of a search is for.
COMPONENT_FACETS = {"variable": "variable_id", "source": "source_id", "experiment": "experiment_id"}
#: The attributes of a store's listing, in the order of predicates (fixed values).
STORE_ATTRIBUTES = ("activity_id", "institution_id", "source_id", "experiment_id", "member_id", "table_id", "variable_id", "grid_label")
