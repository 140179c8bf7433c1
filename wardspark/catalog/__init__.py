"""Rule data: severities, rules, signatures, advisories and compliance controls."""
