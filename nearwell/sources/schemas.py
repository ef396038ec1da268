"""Declared schemas of the source tables."""

BRONZE_FACILITY = """
    unique_id string, name string, facilityTypeId string, operatorTypeId string,
    yearEstablished string, capacity string, numberDoctors string,
    address_city string, address_stateOrRegion string, address_zipOrPostcode string,
    latitude double, longitude double, officialPhone string, officialWebsite string,
    email string, description string, recency_of_page_update string,
    specialties string, procedure string, capability string,
    phone_numbers string, source_urls string"""

PIN_DIRECTORY = "pincode string, district string, statename string, latitude string, longitude string"

REGISTRY = """
    source string, registry_name string, city string, state string, pincode string,
    facility_type string, services string, accredited string"""
