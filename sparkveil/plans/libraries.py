"""Shipped pattern libraries: rows are id, category, confidence, replacement, regex."""

from __future__ import annotations

# The libraries' patterns, in RE2 syntax.
LIBRARIES: dict[str, list[tuple[str, str, float, str, str]]] = {
    "global_pii": [
        ("global_full_name", "personal_name", 0.7, "[NAME_REDACTED]", r"\b[A-Z][a-z]{1,20}\s+[A-Z][a-z]{1,20}(?:\s+[A-Z][a-z]{1,20})?\b"),
        ("global_email", "contact", 0.95, "[EMAIL_REDACTED]", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
        ("global_phone_intl", "contact", 0.9, "[PHONE_REDACTED]", r"\+[1-9]\d{1,14}\b"),
        ("global_phone_common", "contact", 0.8, "[PHONE_REDACTED]", r"\b(?:\+?[1-9]\d{0,3}[-.\s]?)?\(?[0-9]{2,4}\)?[-.\s]?[0-9]{2,4}[-.\s]?[0-9]{2,6}\b"),
        ("global_credit_card", "financial", 0.92, "[CREDIT_CARD_REDACTED]", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|3[0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b"),
        ("global_iban", "financial", 0.9, "[IBAN_REDACTED]", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}([A-Z0-9]?){0,16}\b"),
        ("global_date_iso", "temporal", 0.9, "[DATE_REDACTED]", r"\b\d{4}-\d{2}-\d{2}\b"),
        ("global_date_common", "temporal", 0.8, "[DATE_REDACTED]", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"),
        ("global_ipv4", "network", 0.9, "[IP_REDACTED]", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"),
        ("global_ipv6", "network", 0.95, "[IPV6_REDACTED]", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"),
        ("global_mac_address", "network", 0.95, "[MAC_REDACTED]", r"\b([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})\b"),
        ("global_url", "network", 0.9, "[URL_REDACTED]", r"\bhttps?://[A-Za-z0-9.-]+(?:/[A-Za-z0-9./_?#-]*)?\b"),
        ("global_domain", "network", 0.7, "[DOMAIN_REDACTED]", r"\b[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
        ("global_coordinates", "location", 0.9, "[COORDINATES_REDACTED]", r"\b-?\d{1,3}\.\d{1,10},\s?-?\d{1,3}\.\d{1,10}\b"),
        ("global_uuid", "identifier", 0.95, "[UUID_REDACTED]", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"),
        ("global_api_key", "security", 0.85, "[API_KEY_REDACTED]", r'\b(?:api_key|apikey|access_token|secret_key|private_key)["\s:=]+([A-Za-z0-9_-]{20,})\b'),
        ("global_hash_md5", "security", 0.8, "[MD5_HASH_REDACTED]", r"\b[a-fA-F0-9]{32}\b"),
        ("global_hash_sha256", "security", 0.85, "[SHA256_HASH_REDACTED]", r"\b[a-fA-F0-9]{64}\b"),
    ],
    "uk_gdpr": [
        ("uk_ni_number", "personal_identifier", 0.95, "[NI_NUMBER_REDACTED]", r"\b[A-CEGHJ-PR-TW-Z]{1}[A-CEGHJ-NPR-TW-Z]{1}[0-9]{6}[A-D]{1}\b"),
        ("uk_nhs_number", "health", 0.9, "[NHS_NUMBER_REDACTED]", r"\b[0-9]{3}\s?[0-9]{3}\s?[0-9]{4}\b"),
        ("uk_passport", "personal_identifier", 0.8, "[PASSPORT_REDACTED]", r"\b[0-9]{9}\b"),
        ("uk_driving_licence", "personal_identifier", 0.9, "[DRIVING_LICENCE_REDACTED]", r"\b[A-Z9]{5}\d{6}[A-Z9]{2}\d[A-Z]{2}\b"),
        ("uk_email", "contact_info", 0.95, "[EMAIL_REDACTED]", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
        ("uk_phone", "contact_info", 0.9, "[PHONE_REDACTED]", r"\b(?:\+44\s?|0)(?:[1-9]\d{8,9}|[1-9]\d\s?\d{3}\s?\d{4})\b"),
        ("uk_sort_code", "financial", 0.9, "[SORT_CODE_REDACTED]", r"\b\d{2}-\d{2}-\d{2}\b"),
        ("uk_account_number", "financial", 0.8, "[ACCOUNT_REDACTED]", r"\b\d{8}\b"),
        ("uk_iban", "financial", 0.95, "[IBAN_REDACTED]", r"\bGB\d{2}[A-Z]{4}\d{14}\b"),
        ("uk_postcode", "location", 0.9, "[POSTCODE_REDACTED]", r"\b[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}\b"),
        ("uk_address", "location", 0.8, "[ADDRESS_REDACTED]", r"\b\d+\s+[A-Za-z0-9\s]+(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Close|Cl|Court|Ct|Place|Pl|Way|Crescent|Cres|Gardens|Gdns)\b"),
        ("uk_vat_number", "professional", 0.9, "[VAT_NUMBER_REDACTED]", r"\bGB\d{9}(?:\d{3})?\b"),
        ("uk_company_number", "professional", 0.85, "[COMPANY_NUMBER_REDACTED]", r"\b(?:Company No\.?|Registration No\.?|Reg\.? No\.?)[:\s]*(\d{8})\b"),
        ("uk_ip_address", "network", 0.9, "[IP_REDACTED]", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"),
        ("uk_mac_address", "network", 0.95, "[MAC_REDACTED]", r"\b([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})\b"),
    ],
    "us_hipaa": [
        ("hipaa_name", "direct_identifier", 0.8, "[PATIENT_NAME_REDACTED]", r"\b(?:Patient|Name|Mr\.|Mrs\.|Ms\.|Dr\.)\s+[A-Z][a-z]+\s+[A-Z][a-z]+\b"),
        ("hipaa_address", "direct_identifier", 0.85, "[ADDRESS_REDACTED]", r"\b\d+\s+[A-Za-z0-9\s]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl)\b"),
        ("hipaa_zip_code", "direct_identifier", 0.9, "[ZIP_REDACTED]", r"\b\d{5}(?:-\d{4})?\b"),
        ("hipaa_dates", "direct_identifier", 0.9, "[DATE_REDACTED]", r"\b(?:DOB|Date of Birth|Born|Birth Date)[:\s]*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2})\b"),
        ("hipaa_phone", "direct_identifier", 0.9, "[PHONE_REDACTED]", r"\b(?:\+1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})\b"),
        ("hipaa_email", "direct_identifier", 0.95, "[EMAIL_REDACTED]", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
        ("hipaa_ssn", "direct_identifier", 0.95, "[SSN_REDACTED]", r"\b\d{3}-?\d{2}-?\d{4}\b"),
        ("hipaa_mrn", "direct_identifier", 0.9, "[MRN_REDACTED]", r"\b(?:MRN|Medical Record|Patient ID|Chart)[:\s#]*([A-Z0-9]{6,12})\b"),
        ("hipaa_health_plan", "direct_identifier", 0.85, "[HEALTH_PLAN_REDACTED]", r"\b(?:Policy|Member|Subscriber|Group)[:\s#]*([A-Z0-9]{8,15})\b"),
        ("hipaa_account_numbers", "direct_identifier", 0.8, "[ACCOUNT_REDACTED]", r"\b(?:Account|Acct)[:\s#]*([A-Z0-9]{8,15})\b"),
        ("hipaa_certificate_numbers", "direct_identifier", 0.8, "[CERTIFICATE_REDACTED]", r"\b(?:Certificate|License|Cert|Lic)[:\s#]*([A-Z0-9]{6,15})\b"),
        ("hipaa_vehicle_identifiers", "direct_identifier", 0.85, "[VEHICLE_ID_REDACTED]", r"\b(?:VIN|Vehicle ID|License Plate)[:\s#]*([A-Z0-9]{8,17})\b"),
        ("hipaa_device_identifiers", "direct_identifier", 0.8, "[DEVICE_ID_REDACTED]", r"\b(?:Device|Serial|IMEI|MAC)[:\s#]*([A-Z0-9:-]{8,20})\b"),
        ("hipaa_web_urls", "direct_identifier", 0.9, "[URL_REDACTED]", r"\bhttps?://[A-Za-z0-9.-]+(?:/[A-Za-z0-9./_-]*)?\b"),
        ("hipaa_ip_addresses", "direct_identifier", 0.9, "[IP_REDACTED]", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"),
        ("hipaa_biometric_identifiers", "direct_identifier", 0.9, "[BIOMETRIC_REDACTED]", r"\b(?:Fingerprint|Biometric|Retina|DNA)[:\s#]*([A-Z0-9]{10,30})\b"),
        ("hipaa_photographs", "direct_identifier", 0.8, "[PHOTO_REDACTED]", r"\b(?:Photo|Image|Picture)[:\s]*([A-Za-z0-9._-]+\.(?:jpg|jpeg|png|gif|bmp))\b"),
        ("hipaa_diagnosis_codes", "medical", 0.9, "[DIAGNOSIS_CODE_REDACTED]", r"\b[A-Z]\d{2}(?:\.[A-Z0-9]{1,4})?\b"),
        ("hipaa_procedure_codes", "medical", 0.7, "[PROCEDURE_CODE_REDACTED]", r"\b\d{5}\b"),
    ],
    "us_ccpa": [
        ("ccpa_ssn", "personal_identifier", 0.9, "[SSN_REDACTED]", r"\b\d{3}-?\d{2}-?\d{4}\b"),
        ("ccpa_drivers_license", "personal_identifier", 0.85, "[DL_REDACTED]", r"\b[A-Z]\d{7}\b"),
        ("ccpa_email", "contact_info", 0.95, "[EMAIL_REDACTED]", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
        ("ccpa_phone", "contact_info", 0.9, "[PHONE_REDACTED]", r"\b(?:\+1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})\b"),
        ("ccpa_credit_card", "financial", 0.92, "[CREDIT_CARD_REDACTED]", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|3[0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b"),
        ("ccpa_bank_account", "financial", 0.7, "[ACCOUNT_REDACTED]", r"\b\d{8,17}\b"),
        ("ccpa_medical_record", "health", 0.8, "[MEDICAL_RECORD_REDACTED]", r"\b(?:MRN|MR|Medical Record)[:\s#]*([A-Z0-9]{6,12})\b"),
        ("ccpa_zip_code", "location", 0.85, "[ZIP_REDACTED]", r"\b\d{5}(?:-\d{4})?\b"),
        ("ccpa_address", "location", 0.8, "[ADDRESS_REDACTED]", r"\b\d+\s+[A-Za-z0-9\s]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl)\b"),
        ("ccpa_ip_address", "network", 0.9, "[IP_REDACTED]", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"),
        ("ccpa_mac_address", "network", 0.95, "[MAC_REDACTED]", r"\b([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})\b"),
        ("ccpa_employment_info", "professional", 0.75, "[EMPLOYEE_ID_REDACTED]", r"\b(?:Employee ID|EID|Badge)[:\s#]*([A-Z0-9]{4,10})\b"),
    ],
}
