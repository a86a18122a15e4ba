"""The default mapping set."""

from __future__ import annotations

from snaplevel.mappings.model import Alternative, Element, MappingSet


def _element(level: int, name: str, *alternatives: str | tuple[str, ...]) -> Element:
    return Element(
        level, name, tuple(Alternative((a,) if isinstance(a, str) else a) for a in alternatives)
    )


# Level, element, and the columns that satisfy it. A tuple means all of its columns.
# The entry MEDIA stands for the column that holds the record's media identifier.
MEDIA = "multimediaIdentifier"
DEFAULT_ELEMENTS = (
    _element(0, "PhysicalSpecimenID", "materialSampleID", "catalogNumber", "otherCatalogNumbers",
             "occurrenceID", "materialEntityID"),
    _element(0, "Organization", "ownerInstitutionCode", "institutionID", "institutionCode"),
    _element(1, "Name", "scientificName", "vernacularName", "scientificNameID", "taxonKey",
             "organismName"),
    _element(1, "ObjectType", "preparations", "materialEntityType"),
    _element(1, "License", "license"),
    _element(1, "Modified", "modified"),
    _element(2, "QualitativeLocation", "locality", "county", "municipality", "verbatimLocality",
             "island", "verbatimCoordinates", ("verbatimLongitude", "verbatimLatitude"),
             "continent", "country", "countryCode", "islandGroup", "stateProvince", "waterBody",
             "higherGeography"),
    _element(2, "QuantitativeLocation", "locationID", ("decimalLatitude", "decimalLongitude"),
             "footprintWKT"),
    _element(2, "CollectingAgent", "recordedBy", "recordedByID"),
    _element(2, "DateCollected", "eventDate", "year", "verbatimEventDate"),
    _element(2, "CollectingNumber", "fieldNumber", "recordNumber"),
    _element(2, "Media", "mediaType", "associatedMedia", MEDIA, "references", "accessURI"),
    _element(3, "GeographicalLocalityID", "locationID",
             ("decimalLatitude", "decimalLongitude", "coordinatePrecision",
              "coordinateUncertaintyInMeters", "geodeticDatum"),
             ("footprintWKT", "footprintSRS")),
    _element(3, "OrganizationID", "institutionID"),
    _element(3, "CollectingAgentID", "recordedByID"),
    _element(3, "IdentifiedAsID", "scientificNameID", "taxonKey"),
    _element(3, "IdentifiedByID", "identifiedByID"),
    _element(3, "MediaID", MEDIA),
)

# Text that counts as missing, for every column above and for single columns.
COMMON_SENTINELS = ("", "unknown:undigitized")
COLUMN_SENTINELS = {
    "scientificName": ("incertae sedis",),
    "scientificNameID": ("0",),
    "taxonKey": ("0",),
}


def default_mapping(media_column: str = MEDIA) -> MappingSet:
    """The default rules; ``media_column`` names the column that carries the media identifier."""

    def renamed(element: Element) -> Element:
        return Element(
            element.level,
            element.name,
            tuple(
                Alternative(tuple(media_column if c == MEDIA else c for c in a.columns), a.negated)
                for a in element.alternatives
            ),
        )

    rules = MappingSet(tuple(renamed(e) for e in DEFAULT_ELEMENTS))
    return MappingSet(
        rules.elements,
        {c: COMMON_SENTINELS + COLUMN_SENTINELS.get(c, ()) for c in rules.columns},
    )
